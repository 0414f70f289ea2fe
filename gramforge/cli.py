"""Command line: python -m gramforge PATTERN [-p DIR] ..."""

from __future__ import annotations

import argparse
import os
import sys
import time

from gramforge.functions.ignore import ALWAYS
from gramforge.operators import sink
from gramforge.operators.index import TrigramIndex
from gramforge.operators.search import Search
from gramforge.sources.corpus import from_tree
from gramforge.sources.tree import load_rules, walk


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gramforge", description="Search a directory tree.")
    p.add_argument("pattern", nargs="?")
    p.add_argument("-p", "--path", default=".", help="root directory")
    p.add_argument("--init", action="store_true", help="build the index and do nothing else")
    p.add_argument("--yes", action="store_true", help="with --init: rebuild an index without asking")
    p.add_argument("-t", "--type", nargs="+", default=[], help="extensions with their dot")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-r", "--regex", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--json-bytes", action="store_true", help="JSON in which each byte from 0x80 on is an escape of its own")
    p.add_argument("--files-only", action="store_true")
    p.add_argument("--limit", type=int, default=0, help="files at most; 0: all")
    p.add_argument("--reindex", action="store_true")
    p.add_argument("--no-index", action="store_true")
    p.add_argument("--index", help="folder of the index; default: .gramforge below the root")
    p.add_argument("--mode", choices=("compat", "lossless"), default="compat")
    p.add_argument("--threads", type=int, default=0, help="local tasks; 0: all cores")
    return p


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if a.pattern is None and not a.init:
        parser().error("no pattern")
    if not os.path.isdir(a.path):
        print(f"no such directory: {a.path}", file=sys.stderr)
        return 1
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(f"local[{max(1, a.threads) if a.threads else '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    root = os.path.realpath(a.path)
    rules = tuple(load_rules(root))
    index = TrigramIndex(spark, a.index or os.path.join(root, ".gramforge"))
    if a.init:
        return init(index, root, a, rules, out)
    if a.reindex:
        build(index, root, a, rules)
    search = Search(from_tree(spark, root, (), () if a.no_index else ALWAYS), index if index.exists() else None).ext(*a.type).ignore(*rules).limit(a.limit)
    search = search.regex(a.pattern, a.ignore_case) if a.regex else search.literal(a.pattern, a.ignore_case)
    search = search.files_only() if a.files_only else search
    results = (search.without_index() if a.no_index else search).to_df()
    out.write(sink.json_document(results, a.json_bytes) if a.json or a.json_bytes else sink.text_document(results))
    return 0


def build(index: TrigramIndex, root: str, a: argparse.Namespace, rules: tuple[str, ...]) -> None:
    TrigramIndex.build(from_tree(index.spark, root, tuple(a.type), (*rules, *ALWAYS), use_gitignore=False), index.path, a.mode)


def init(index: TrigramIndex, root: str, a: argparse.Namespace, rules: tuple[str, ...], out) -> int:
    """Builds the index of a directory; asks before it replaces one. Says how many files there are, how long it took, where
    the index is and what its lists take."""
    out.write(f"indexing {root}\n")
    if index.exists() and not a.yes:
        out.write(f"there is an index in {index.path}; rebuild it? [y/N] ")
        out.flush()
        if sys.stdin.readline().strip().lower() != "y":
            out.write("kept\n")
            return 0
    out.write(f"{sum(1 for _ in walk(root, a.type, (*rules, *ALWAYS)))} files\n")
    start = time.perf_counter()
    build(index, root, a, rules)
    out.write(f"built in {round(1000 * (time.perf_counter() - start))} ms: {index.path}\n")
    s = index.stats().first()
    out.write(f"{s.trigrams} trigrams, {s.pairs or 0} pairs, {s.delta_bytes or 0} of {s.raw_bytes or 0} bytes as differences\n")
    return 0
