"""Column expressions over the bytes and lines of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the index and of binary detection.
BINARY_PREFIX = 8192
MIN_LINE, MAX_LINE = 3, 512


def fold(c: Column) -> Column:
    """ASCII lower case: other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def byte_view(c: Column) -> Column:
    """A string with one character for each byte of c, so that positions and lengths count bytes."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def is_text(content: Column) -> Column:
    """Not empty, and no NUL among the first bytes."""
    head = F.substring(content.cast("binary"), 1, BINARY_PREFIX)
    return (F.octet_length(content) > 0) & (F.instr(F.decode(head, "ISO-8859-1"), "\0") == 0)


def raw_lines(content: Column) -> Column:
    """Array of lines. A line break at the very end starts no further line; the empty text has none."""
    parts = F.split(content, "\n", -1)
    return F.when(F.octet_length(content) == 0, F.array().cast("array<string>")).otherwise(F.when(F.endswith(content, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def without_cr(line: Column) -> Column:
    """The line without one carriage return at its end."""
    return F.when(F.endswith(line, F.lit("\r")), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def lines(content: Column) -> Column:
    return F.transform(raw_lines(content), without_cr)


def numbered(content: Column) -> Column:
    """Array of struct<line, content>; lines count from 1."""
    return F.transform(lines(content), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("content")))


def indexable(raw_line: Column) -> Column:
    """Whether the compat index holds a line; its length includes a carriage return."""
    n = F.octet_length(raw_line)
    return (n >= MIN_LINE) & (n <= MAX_LINE) & raw_line.rlike("[0-9A-Za-z]")


def byte_offset(line: Column, char_place: Column) -> Column:
    """Bytes before the character at a place that counts from 1."""
    return F.octet_length(F.substr(line, F.lit(1), char_place - 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on; empty where that dot is the name's first character or missing."""
    return F.regexp_extract(path, "[^/](\\.[^./]*)$", 1)


def relative(path: Column, root: str) -> Column:
    """The path without the root in front, and without one slash after it."""
    rest = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    return F.when(F.startswith(path, F.lit(root)) & F.startswith(rest, F.lit("/")), F.substr(rest, F.lit(2), F.length(rest))).otherwise(rest)


def json_string(c: Column, ascii_bytes: bool = False) -> Column:
    """c escaped for JSON. ascii_bytes: each byte from 0x80 on becomes an escape of its own, as some readers of the old
    format expect; otherwise the text stays UTF-8."""
    x = byte_view(c) if ascii_bytes else c
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(raw), F.lit(code))
    one = lambda ch: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(ch))), 4, "0"))
    odd = "[\\x00-\\x1f" + ("\\x80-\\xff" if ascii_bytes else "") + "]"
    spelled = F.array_join(F.transform(F.split(x, ""), lambda ch: F.when(ch.rlike("(?s)^" + odd + "$"), one(ch)).otherwise(ch)), "")
    return F.when(x.rlike(odd), spelled).otherwise(x)
