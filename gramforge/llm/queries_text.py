"""Queries that score, encode or measure each text on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramforge.llm import bpe, convnet, forest, toxicity
from gramforge.llm.common import table


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convnet.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_isolation_forest": op6_isolation_forest, "op2_byte_convnet": op2_byte_convnet, "op4_kneser_ney_toxicity": op4_kneser_ney_toxicity, "op8_byte_bpe": op8_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
