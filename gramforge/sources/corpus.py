"""Corpora: DataFrames of file_id, path and content, from tables and from directory trees."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramforge.functions import text
from gramforge.functions.ignore import Rules, kept
from gramforge.sources.tree import TreeSource, contents, load_rules
from gramforge.workers import ready

#: Metadata of the path of a corpus from a tree: its files are known by path, and read by path one at a time.
TREE = "gramforge.tree"


def from_table(df: DataFrame, file_id: str, content: str, path: Column | str) -> DataFrame:
    """Rows of a table as files."""
    at = F.col(path) if isinstance(path, str) else path
    return df.select(F.col(file_id).cast("long").alias("file_id"), at.alias("path"), F.col(content).alias("content"))


def from_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), rules: tuple[str, ...] = (), use_gitignore: bool = True) -> DataFrame:
    """The regular files below a directory that every executor sees, with paths relative to it, numbered by path from 0.
    The numbers change with the tree, so searches know its files by path."""
    ready(spark).dataSource.register(TreeSource)
    every = [*rules, *(load_rules(root) if use_gitignore else [])]
    reader = spark.read.format("tree").option("root", root).option("extensions", "\n".join(extensions)).option("rules", "\n".join(every)).option("gitignore", "false")
    return reader.load().withMetadata("path", {TREE: json.dumps({"root": root, "extensions": list(extensions), "rules": every})})


def known_by(corpus: DataFrame) -> str:
    """The column by which an index and a corpus mean the same file: path in trees, file_id in tables."""
    return "path" if TREE in corpus.schema["path"].metadata else "file_id"


def of_paths(corpus: DataFrame, files: DataFrame) -> DataFrame:
    """Of a corpus from a tree those files (file_id, path) that it has, without walking it: they alone are read."""
    own = json.loads(corpus.schema["path"].metadata[TREE])
    at = files.filter(kept(F.col("path"), Rules.of(own["rules"])))
    if own["extensions"]:
        at = at.filter(text.extension(F.col("path")).isin(*own["extensions"]))
    return contents(at, own["root"])


def number_paths(paths: DataFrame) -> DataFrame:
    """path and place (by path, from 0), sorted in partitions; only the partitions' sizes are summed up in one task."""
    paths = paths.select("path").repartitionByRange("path").sortWithinPartitions("path")
    paths = paths.select("path", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")).checkpoint()
    place = paths.select("path", "_p", (F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)).alias("_k"))
    sizes = paths.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return place.join(before, "_p").select("path", (F.col("_before") + F.col("_k")).alias("place"))
