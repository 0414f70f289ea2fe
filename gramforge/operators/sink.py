"""Results as JSON and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.text import json_string


def json_rows(results: DataFrame, ascii_bytes: bool = False) -> DataFrame:
    """path and json: an object with file, match_count, density to six digits and, where the results have them, matches."""
    q = lambda c: F.concat(F.lit('"'), json_string(c, ascii_bytes), F.lit('"'))
    head = F.concat(F.lit('{"file": '), q(F.col("path")), F.lit(', "match_count": '), F.col("match_count").cast("string"), F.lit(', "density": '), F.format_string("%.6f", F.bround("density", 6)))
    if "matches" in results.columns:
        one = lambda m: F.concat(F.lit('{"line": '), m["line"].cast("string"), F.lit(', "content": '), q(m["content"]), F.lit("}"))
        head = F.concat(head, F.lit(', "matches": ['), F.array_join(F.transform("matches", one), ", "), F.lit("]"))
    return results.select(*(c for c in ("file_id", "path") if c in results.columns), F.concat(head, F.lit("}")).alias("json"))


def text_rows(results: DataFrame) -> DataFrame:
    """path and text: the path, then a numbered line for each match; without matches, the path and their number."""
    if "matches" in results.columns:
        body = F.array_join(F.transform("matches", lambda m: F.concat(F.lpad(m["line"].cast("string"), F.greatest(F.lit(6), F.length(m["line"].cast("string")) + 2), F.lit(" ")), F.lit("  "), m["content"])), "\n")
        text = F.concat("path", F.lit("\n"), body)
    else:
        text = F.concat("path", F.lit("  "), F.col("match_count").cast("string"), F.when(F.col("match_count") == 1, " match ").otherwise(" matches "))
    return results.select(*(c for c in ("file_id", "path") if c in results.columns), text.alias("text"))


def json_document(results: DataFrame, ascii_bytes: bool = False) -> str:
    """The array that the command line prints. Gathers the results; use json_rows(...).write for large ones."""
    return "[\n" + ",\n".join("  " + r["json"] for r in json_rows(results, ascii_bytes).collect()) + "\n]\n"


def text_document(results: DataFrame) -> str:
    rows = [r["text"] for r in text_rows(results).collect()]
    return ("\n\n" if "matches" in results.columns else "\n").join(rows) + ("\n" if rows else "")
