"""Queries over pairs and groups of documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramforge.llm import jaccard, recompress, vectors
from gramforge.llm.common import table


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup(table(spark, sf_dir, "documents")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op7_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_recompression": op5_recompression, "op10_prefix_tree_join": op10_prefix_tree_join, "op7_pivot_permutation": op7_pivot_permutation}
ORACLE_SQL: dict[str, str] = {}
