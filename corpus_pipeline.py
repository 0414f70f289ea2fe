"""A pipeline over `documents`: toxic documents go, one of each group of near copies stays, passages that an earlier
document has go, sources are mixed to target weights, and what is left is encoded.

Each stage is written as Parquet and read again by the next one. Of near copies one row stays, whatever ids the rows have or
share; in the other stages rows that share a doc_id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.llm import bpe, jaccard, mixing, recompress, toxicity
from gramforge.llm.common import table, written

#: Tokens drawn are as many as there are; sources are flattened up to this share of the largest entropy.
MIXTURE = mixing.Target(entropy=0.95, max_repeats=4.0, budget=1.0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The models learn from all labelled rows of `labels` that are among docs (a bounded sample of them)."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), lambda c: F.lit(True))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id, rows without an id last."""
    return jaccard.without_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses words keeps the others, joined by one space, with n_chars to match; one that loses all goes."""
    left = recompress.dedup(docs).filter("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return left.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn(docs, MIXTURE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document (`ids`, little-endian unsigned 32-bit integers), their number and digests."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("mixing", mix_sources), ("encoding", encode)]

#: No SQL: models, hash permutations and BPE. tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
