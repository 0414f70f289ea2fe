"""Searches: what to look for, where, and how the results are cut."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions import text
from gramforge.functions.dialect import BadPattern
from gramforge.functions.ignore import Rules, kept
from gramforge.operators.index import IndexMismatch, TrigramIndex
from gramforge.operators.scan import Pattern, ranked, scan
from gramforge.sources.corpus import known_by, of_paths

log = logging.getLogger(__name__)
#: Candidates that are gathered on the driver and sent to all tasks at most (some MB), and ranges of their ids in a filter.
FEW, RANGES = 100_000, 64


@dataclass(frozen=True)
class Search:
    """An immutable builder over a corpus (file_id, path, content). to_df() gives one row for each matching file, the
    densest first."""

    corpus: DataFrame
    index: TrigramIndex | None = None
    pattern: Pattern | None = None
    extensions: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    most: int = 0
    only_files: bool = False
    indexed: bool = True

    def literal(self, value: str, ignore_case: bool = False) -> Search:
        return replace(self, pattern=Pattern(value, ignore_case=ignore_case))

    def regex(self, value: str, ignore_case: bool = False) -> Search:
        return replace(self, pattern=Pattern(value, regex=True, ignore_case=ignore_case))

    def with_index(self, index: TrigramIndex | None) -> Search:
        return replace(self, index=index)

    def without_index(self) -> Search:
        return replace(self, indexed=False)

    def ext(self, *extensions: str) -> Search:
        """Extensions with their dot, as they are written; none: all files."""
        return replace(self, extensions=extensions)

    def ignore(self, *rules: str) -> Search:
        return replace(self, rules=rules)

    def limit(self, files: int) -> Search:
        return replace(self, most=files)

    def files_only(self) -> Search:
        return replace(self, only_files=True)

    def scanned(self) -> DataFrame:
        """The corpus that the rules and extensions leave, without an index."""
        out = self.corpus.filter(kept(F.col("path"), Rules.of(self.rules)))
        return out.filter(text.extension(F.col("path")).isin(*self.extensions)) if self.extensions else out

    def found(self) -> DataFrame:
        """The results in no order. Regular expressions and searches without an index scan all files that the rules leave.
        An index narrows literals; after it only the rules on files are asked again, and the extensions, of the paths that
        it returns."""
        uses_index = self.indexed and self.index is not None and not self.pattern.regex
        if not uses_index:
            if not self.pattern.regex and self.indexed:
                log.warning("no index: scanning all files")
            return self._scan(self.scanned())
        state = self.index.manifest()
        plan = self.index.plan(self.pattern.value, state)
        if plan.nothing:
            return self._scan(self.corpus.limit(0))
        tree = known_by(self.corpus) == "path"
        if plan.required and not (tree or self.rules or self.extensions):
            known = self.index.candidate_ids(plan, state)  # paths aren't asked for
        else:
            known = self.index.candidates(self.pattern.value, plan, state)
            known = known.filter(kept(F.col("path"), Rules.of(self.rules), files_only=True))
            if self.extensions:
                known = known.filter(text.extension(F.col("path")).isin(*self.extensions))
        if tree:
            return self._scan(of_paths(self.corpus, known))
        if plan.most is not None and plan.most <= FEW:
            ids = sorted(r["file_id"] for r in known.select("file_id").collect())  # FEW at most
            return self._scan(with_ids(self.corpus, ids))
        # most files are candidates: they are scanned as they lie, and what is found is narrowed
        return self._scan(self.corpus).join(known.select("file_id"), "file_id", "left_semi")

    def _scan(self, files: DataFrame) -> DataFrame:
        return scan(files, self.pattern, self.only_files)

    def to_df(self) -> DataFrame:
        if self.pattern is None:
            raise ValueError("no pattern")
        try:
            if self.pattern.regex:
                self.corpus.sparkSession.range(1).select(F.lit("").rlike(self.pattern.java())).collect()
            found = self.found()
        except (BadPattern, IndexMismatch, PySparkException) as e:
            if isinstance(e, PySparkException) and not str(e.getCondition()).startswith("INVALID_PARAMETER_VALUE.PATTERN"):
                raise
            log.warning("%s", e)
            found = scan(self.corpus.limit(0), Pattern(""), self.only_files)
        return ranked(found, self.most)


def ranges(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ascending numbers as ranges, `most` at most, cut where the gaps are widest."""
    cuts = sorted(sorted(range(1, len(ids)), key=lambda i: (ids[i - 1] - ids[i], i))[: most - 1])
    cuts = [i for i in cuts if ids[i] - ids[i - 1] > 1]
    return [(ids[a], ids[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]


def with_ids(corpus: DataFrame, ids: list[int]) -> DataFrame:
    """The files with these ids, and nothing else read where files are stored by id: a scan gets the ranges of ids as a
    filter, by which it leaves out row groups and pages. The content is tied to the join, so that no test of it can be
    moved in front of it."""
    if not ids:
        return corpus.limit(0)
    near = reduce(lambda a, b: a | b, (F.col("file_id").between(a, b) for a, b in ranges(ids)))
    wanted = corpus.sparkSession.createDataFrame([(i, True) for i in ids], "file_id long, _asked boolean")
    out = corpus.filter(near).join(F.broadcast(wanted), "file_id")
    return out.withColumn("content", F.when(F.col("_asked"), F.col("content"))).select(*corpus.columns)
