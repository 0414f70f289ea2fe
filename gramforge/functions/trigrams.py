"""Byte trigrams: three bytes a, b, c as the number a * 65536 + b * 256 + c."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.functions.text import MAX_LINE, MIN_LINE
from gramforge.workers import ready

#: Bytes that make a trigram noise if it has no others: fixed values.
NOISE = b" (){}[];\t"
MAX_TRIGRAMS = 4
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def of_pattern(pattern: bytes) -> list[int]:
    return sorted({pattern[i] << 16 | pattern[i + 1] << 8 | pattern[i + 2] for i in range(len(pattern) - 2)})


def is_noise(trigram: int) -> bool:
    return all(b in NOISE for b in trigram.to_bytes(3, "big"))


#: Bytes of a text that are worked on at once; distinct (trigram, file_id) whose lists are made, or that are returned, at once.
PIECE_BYTES, MOST_PAIRS = 1 << 19, 1 << 19


def of_content(content: bytes, everything: bool = False) -> np.ndarray:
    """The distinct trigrams of the indexable lines, ascending. everything: of all lines, in ASCII lower case."""
    own = np.zeros(0, np.int32)
    for piece in _pieces(np.frombuffer(content, np.uint8), everything):
        found = _of_piece(piece, everything)
        own = np.union1d(own, found) if len(own) else found
    return own


def _pieces(raw: np.ndarray, everything: bool) -> Iterator[np.ndarray]:
    """A text cut behind line breaks. A line that is longer than a piece isn't indexable; with everything, its pieces overlap
    by two bytes, so that each of its trigrams is in one."""
    start = 0
    while len(raw) - start > PIECE_BYTES:
        piece = raw[start : start + PIECE_BYTES]
        breaks = np.flatnonzero(piece == 10)
        if len(breaks):
            yield piece[: breaks[-1] + 1]
            start += int(breaks[-1]) + 1
        elif everything:
            yield piece
            start += PIECE_BYTES - 2
        else:
            start += PIECE_BYTES
            while start < len(raw):
                breaks = np.flatnonzero(raw[start : start + PIECE_BYTES] == 10)
                start += int(breaks[0]) + 1 if len(breaks) else PIECE_BYTES
                if len(breaks):
                    break
    yield raw[start:]


def _of_piece(raw: np.ndarray, everything: bool) -> np.ndarray:
    if len(raw) < MIN_LINE:
        return np.zeros(0, np.int32)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    if everything:
        raw = _UPPER[raw]
        good = size >= MIN_LINE
    else:
        words = np.concatenate([[0], np.cumsum(_ALNUM[raw])])
        good = (size >= MIN_LINE) & (size <= MAX_LINE) & (words[ends] > words[starts])
    # a place counts if its line does and two more bytes of the line follow
    step = np.zeros(len(raw) + 1, np.int32)
    step[starts[good]] += 1
    step[np.maximum(ends[good] - 2, 0)] -= 1
    at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    wide = raw.astype(np.int32)
    return np.unique(wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2])


def _groups(batches: Iterator[pa.RecordBatch], everything: bool, only: list[int] | None = None) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """File ids and their distinct trigrams (those in `only`), as many texts at once as have some MOST_PAIRS pairs. What was
    yielded has to be let go before the next is asked for; texts are read where they lie in their batch."""
    ids, own, held = [], [], 0
    for batch in batches:
        for i, content in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
            found = of_content(content.as_buffer() if content.is_valid else b"", everything)
            found = found if only is None else found[np.isin(found, only)]
            ids.append(i)
            own.append(found)
            held += len(found) + 1
            if held > MOST_PAIRS:
                yield ids, own
                ids, own, held = [], [], 0
        batch = content = None  # not held while the next is read
    if ids:
        yield ids, own


def _contents(corpus: DataFrame) -> DataFrame:
    ready(corpus.sparkSession)
    return corpus.select(F.col("file_id").cast("long").alias("file_id"), F.col("content").cast("binary").alias("content"))


def with_trigrams(corpus: DataFrame, everything: bool = False, only: list[int] | None = None) -> DataFrame:
    """file_id and trigrams (array of its distinct ones, or of those in `only`) for each text of a corpus; one pass, no
    shuffle. Byte work over every position of a text: array arithmetic over Arrow batches does it far faster than an
    expression for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in _groups(batches, everything, only):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own), pa.int32()))], ["file_id", "trigrams"])
            del ids, own, offsets

    return _contents(corpus).mapInArrow(run, "file_id long, trigrams array<int>")


def partial_lists(corpus: DataFrame, segment_bits: int, everything: bool = False) -> DataFrame:
    """trigram, segment and file_ids (ascending): posting lists of some texts each, so that what is shuffled later is one row
    for a trigram and not one for each pair."""

    def lists(ids: np.ndarray, own: list[np.ndarray]) -> pa.RecordBatch:
        # trigram and place of the id as one number, sorted in place
        ids, place = np.unique(ids, return_inverse=True)
        keys = np.concatenate(own).astype(np.int64)
        keys <<= 32
        keys |= np.repeat(place, [len(x) for x in own])
        keys.sort()
        owner = ids[keys & 0xFFFFFFFF]
        keys >>= 32
        flat = keys.astype(np.int32)
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] >> segment_bits != owner[:-1] >> segment_bits)
        starts = np.flatnonzero(new)
        offsets = np.append(starts, len(flat)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(flat[starts]), pa.array(owner[starts] >> segment_bits), pa.ListArray.from_arrays(pa.array(offsets), pa.array(owner))], ["trigram", "segment", "file_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in _groups(batches, everything):
            yield lists(np.array(ids, np.int64), own)
            del ids, own

    return _contents(corpus).mapInArrow(run, "trigram int, segment long, file_ids array<long>")


def delta_encoded(ids: Column) -> Column:
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1)))


def delta_decoded(deltas: Column) -> Column:
    """Running sums over Arrow batches: an expression would copy or sum each prefix again."""
    return F.pandas_udf(_summed, "array<long>")(deltas)


def _summed(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else np.cumsum(x))
