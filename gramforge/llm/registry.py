"""The queries of this subpackage: one opN_<name> for each operator, over its whole table, and their SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = [f"gramforge.llm.queries_{name}" for name in ("text", "pairs", "tables")]


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(module), name)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
