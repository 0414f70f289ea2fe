"""Keeping an index up to date: a stream of changes, applied in micro-batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from gramforge.functions.text import extension
from gramforge.operators.index import TrigramIndex
from gramforge.sources.corpus import number_paths
from gramforge.sources.tree import TreeReader, contents, walk
from gramforge.workers import ready

CHANGE_SCHEMA = "path string, op string"
#: Layers from which an index is compacted.
MOST_LAYERS = 16


class TreeChanges(SimpleDataSourceStreamReader):
    """Changes of a tree between snapshots of path, time and size: modify (new files included) and delete; names only, what
    files hold is read by tasks. The offset is the snapshot, so a restart goes on where it was; it suits trees of some ten
    thousand files."""

    def __init__(self, options: dict[str, str]):
        own = TreeReader(options)
        self.root, self.extensions, self.rules = own.root, own.extensions, own.rules

    def _snapshot(self) -> dict[str, str]:
        return {path: f"{info.st_mtime_ns}:{info.st_size}" for path, info in walk(self.root, self.extensions, self.rules)}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def read(self, start: dict):
        old, now = json.loads(start["files"]), self._snapshot()
        return iter(between(old, now)), (start if old == now else {"files": json.dumps(now)})

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(between(json.loads(start["files"]), json.loads(end["files"])))


def between(old: dict[str, str], new: dict[str, str]) -> list[tuple]:
    return [(p, "delete") for p in sorted(old.keys() - new.keys())] + [(p, "modify") for p in sorted(p for p, v in new.items() if old.get(p) != v)]


class TreeChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return CHANGE_SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TreeChanges(dict(self.options))


def events(changes: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """The changes that concern an index: named files outside its folder, with one of the extensions if any are given."""
    out = changes.filter(F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").rlike(r"(^|/)\.gramforge(/|$)"))
    return out.filter(extension(F.col("path")).isin(*extensions)) if extensions else out


def apply_changes(index: TrigramIndex, changes: DataFrame, root: str | None = None, batch: tuple[str, int] | None = None) -> None:
    """One micro-batch (path, op, and content unless `root` says where files are read): the last change of each path counts
    (by `seq`, where there is one; else a deletion does). Known paths keep their ids, new ones get the next free numbers. A
    file that can't be read any more is gone. A batch that the index has already isn't applied again."""
    state = index.manifest()
    if batch is not None and state.batches.get(batch[0], -1) >= batch[1]:
        return
    held = ["op"] if root is not None else ["op", "content"]
    last = changes.groupBy("path").agg(F.max_by(F.struct(*held), F.col("seq") if "seq" in changes.columns else F.when(F.col("op") == "delete", 1).otherwise(0)).alias("_c")).select("path", "_c.*")
    last = last.persist()
    try:
        if last.isEmpty():
            return
        files = index.table("files", state)
        known = files.filter("path is not null").groupBy("path").agg(F.max("file_id").alias("file_id"))
        top = files.agg(F.coalesce(F.max("file_id"), F.lit(-1))).first()[0]
        names = last.select("path", "op").join(known, "path", "left")
        fresh = number_paths(names.filter("file_id is null and op != 'delete'")).select("path", (F.col("place") + top + 1).alias("file_id"))
        ids = known.join(last.select("path"), "path", "left_semi").unionByName(fresh)
        changed = last.filter("op != 'delete'").join(ids, "path").select("file_id", "path", *held[1:])
        gone = names.filter("file_id is not null and op = 'delete'").select("file_id")
        if root is not None:
            asked = changed
            changed = contents(asked, root).persist()  # read once: what is missing here is gone everywhere
            gone = gone.unionByName(asked.join(changed.select("file_id"), "file_id", "left_anti").select("file_id"))
        layer = index.apply(changed, gone, batch)
        if layer >= MOST_LAYERS:
            index.compact()
    finally:
        last.unpersist()


def keep_updated(changes: DataFrame, index: TrigramIndex, checkpoint: str, extensions: tuple[str, ...] = (), root: str | None = None, **trigger) -> StreamingQuery:
    """A streaming query that applies a stream of changes (path, op, content) to an index. Its checkpoint folder is the name
    by which the index remembers its last batch, so that a batch that is run again after a failure counts once."""

    def batch(df: DataFrame, number: int) -> None:
        apply_changes(index, df, root, (checkpoint, number))

    writer = events(changes, extensions).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def watch_tree(spark: SparkSession, root: str, index: TrigramIndex, checkpoint: str, **trigger) -> StreamingQuery:
    ready(spark).dataSource.register(TreeChangesSource)
    return keep_updated(spark.readStream.format("tree_changes").option("root", root).load(), index, checkpoint, root=root, **trigger)
