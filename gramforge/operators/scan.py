"""Line scans: which lines of which texts match, and how densely."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.functions import dialect, text


@dataclass(frozen=True)
class Pattern:
    """A literal, or a regular expression in the dialect of RE2; ignore_case folds ASCII in literals, Unicode in
    regular expressions."""

    value: str
    regex: bool = False
    ignore_case: bool = False

    def java(self) -> str:
        return dialect.to_java(self.value, self.ignore_case)

    def matches(self, line: Column) -> Column:
        if self.regex:
            return line.rlike(self.java())
        if self.ignore_case:
            return F.contains(text.fold(line), F.lit(_folded(self.value)))
        return F.contains(line, F.lit(self.value))

    def span(self, line: Column) -> tuple[Column, Column]:
        """Start and length in bytes of the first match in a line that matches."""
        if self.regex:
            java = F.lit(self.java())
            return text.byte_offset(line, F.regexp_instr(line, java)), F.coalesce(F.octet_length(F.regexp_substr(line, java)), F.lit(0))
        at = F.instr(text.fold(line), _folded(self.value)) if self.ignore_case else F.instr(line, self.value)
        return text.byte_offset(line, at), F.lit(len(self.value.encode()))

    def whole(self, content: Column) -> Column | None:
        """A test of a whole text that all texts with a matching line pass."""
        if self.regex or not self.value:
            return None
        return F.contains(text.fold(content), F.lit(_folded(self.value))) if self.ignore_case else F.contains(content, F.lit(self.value))


def _folded(value: str) -> str:
    return value.translate(str.maketrans(text.UPPER, text.LOWER))


def once(c: Column) -> Column:
    """c, worked out once for a row: a filter on it is not moved in front of it with a copy of c."""
    return F.explode(F.array(c))


def texts_of(corpus: DataFrame) -> DataFrame:
    """The corpus without empty and binary contents; contents as strings."""
    return corpus.filter(F.col("content").isNotNull() & text.is_text(F.col("content"))).withColumn("content", F.col("content").cast("string"))


def scan(corpus: DataFrame, pattern: Pattern, files_only: bool = False) -> DataFrame:
    """file_id, path, match_count, total_lines, density and, unless files_only, matches (array of line, content,
    match_start, match_len) of the texts with a matching line. Everything about a text happens in its row: no shuffle."""
    texts = texts_of(corpus)
    if (test := pattern.whole(F.col("content"))) is not None:
        texts = texts.filter(test)
    cols = [c for c in ("file_id", "path") if c in corpus.columns]
    if files_only:
        lined = texts.select(*cols, once(text.lines(F.col("content"))).alias("_l"))
        found = lined.select(*cols, F.size("_l").alias("total_lines"), once(F.size(F.filter("_l", pattern.matches)).cast("long")).alias("match_count"))
        extra = []
    else:
        hit = lambda m: pattern.matches(m["content"])

        def record(m: Column) -> Column:
            start, length = pattern.span(m["content"])
            return F.struct(m["line"].alias("line"), m["content"].alias("content"), start.cast("int").alias("match_start"), length.cast("int").alias("match_len"))

        lined = texts.select(*cols, once(text.numbered(F.col("content"))).alias("_l"))
        found = lined.select(*cols, F.size("_l").alias("total_lines"), once(F.filter("_l", hit)).alias("_m"))
        found = found.select(*cols, "total_lines", F.size("_m").cast("long").alias("match_count"), F.transform("_m", record).alias("matches"))
        extra = ["matches"]
    density = F.col("match_count").cast("double") / F.col("total_lines")
    return found.filter("match_count > 0").select(*cols, "match_count", "total_lines", density.alias("density"), *extra)


def ranked(results: DataFrame, limit: int = 0) -> DataFrame:
    """The densest first, equal ones by path and id; limit 0: all."""
    keys = [c for c in ("path", "file_id") if c in results.columns]
    order = [F.desc("density"), *(F.asc(c) for c in keys)]
    if limit > 0:
        return results.orderBy(*order).limit(limit)
    # a sort looks at its input twice: once dealt out, results are looked at again, and not the corpus
    return results.repartition(*keys).orderBy(*order) if keys else results.orderBy(*order)
