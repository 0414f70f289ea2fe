"""A directory tree as a data source.

Spark's own file sources leave out names that start with a dot or an underscore, and empty files; a tree of source code has
both. The tree is walked on the driver, names only, which it sorts and numbers; contents are read by the tasks, from a file
system that they share.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gramforge.functions.ignore import Rules, read_rules
from gramforge.workers import ready

#: Bytes and files of a task.
TASK_BYTES, TASK_FILES = 32 << 20, 4096


def load_rules(root: str) -> list[str]:
    """The rules of the root's .gitignore."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="surrogateescape") as f:
            return read_rules(f.read())
    except OSError:
        return []


def extension(name: str) -> str:
    """From the last dot on, as filesystem libraries see it: none for names whose only dot comes first."""
    at = name.rfind(".")
    return name[at:] if at > 0 and name != ".." else ""


def walk(root: str, extensions: list[str] | tuple[str, ...] = (), rules: list[str] | tuple[str, ...] = ()) -> Iterator[tuple[str, os.stat_result]]:
    """Relative paths of regular files, sorted. Ignored directories aren't entered; unreadable ones are passed over; links
    to directories aren't followed, links to files are files."""
    own = Rules.of(rules)
    no_file, no_dir = (re.compile(_python(x)) if x else None for x in (own.file_regex(), own.dir_regex()))
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    for at, dirs, names in os.walk(root):
        here = os.path.relpath(at, root).replace(os.sep, "/")
        prefix = "" if here == "." else here + "/"
        dirs[:] = sorted(d for d in dirs if not (no_dir and no_dir.match(prefix + d + "/")))
        for name in sorted(names):
            path = prefix + name
            if no_file and no_file.match(path) or extensions and extension(name) not in extensions:
                continue
            try:
                info = os.stat(os.path.join(at, name))
            except OSError:
                continue
            if os.path.isfile(os.path.join(at, name)):
                yield path, info


def content(root: str, path: str) -> bytes | None:
    """What a file holds; None if it can't be read."""
    try:
        with open(os.path.join(root, path), "rb") as f:
            return f.read()
    except OSError:
        return None


def contents(files: DataFrame, root: str) -> DataFrame:
    """file_id, path and content of the files (file_id, path) that can be read; tasks read them, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for number, path in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path")), strict=True):
                if (data := content(root, path)) is None:
                    continue
                held.append((number, path, data))
                size += len(data)
                if size > TASK_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    ready(files.sparkSession)
    return files.select(F.col("file_id").cast("long").alias("file_id"), "path").mapInArrow(run, "file_id long, path string, content binary")


def _batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["file_id", "path", "content"])


def _python(regex: str) -> str:
    """The classes that rules compile to, in Python's dialect."""
    for name, body in {"Alpha": "A-Za-z", "Digit": "0-9", "Alnum": "0-9A-Za-z", "Upper": "A-Z", "Lower": "a-z", "Space": "\\s", "XDigit": "0-9A-Fa-f", "Punct": "!-/:-@\\[-`{-~", "Blank": " \\t"}.items():
        regex = regex.replace("\\p{" + name + "}", body)
    return regex


class FilesPartition(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        listed = lambda name: [x for x in options.get(name, "").split("\n") if x]
        self.extensions, self.rules = listed("extensions"), listed("rules")
        if options.get("gitignore", "true") == "true":
            self.rules += load_rules(self.root)

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        found = sorted((path, info.st_size) for path, info in walk(self.root, self.extensions, self.rules))
        for number, (path, own) in enumerate(found):
            if held and (size + own > TASK_BYTES or len(held) == TASK_FILES):
                out.append(FilesPartition(held))
                held, size = [], 0
            held.append((number, path))
            size += own
        return [*out, FilesPartition(held)]

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        for number, path in partition.files:
            if (data := content(self.root, path)) is not None:
                yield number, path, data


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "file_id long, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))
