"""Substring dedup by recompression.

Words are symbols. A round names each maximal run of a symbol, then each pair of neighbours of which the first falls on the
left and the second on the right side of a partition of all symbols by hash; names are hashes, so every task gives equal
runs and pairs equal names. Equal substrings thus get the same symbols inside, and only near their ends may these differ:
each symbol carries the range of words that decides it. A window holds a symbol for certain if that range lies in it.

Each window picks one of the certain symbols of its highest level, the least by hash, so equal windows pick alike. The
words that decide the picked symbol are its key. Only windows whose key occurs in several documents can be repeats: the
shared symbols reveal them. These are verified by 96 bits of all their words, and the smallest document of each is found:
a block sends each of its distinct windows once, with the smallest id it has it in, and is told whether another block has a
smaller one. What its own documents share it sees itself.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gramforge.llm import blocks as B
from gramforge.llm.common import trim

U = np.uint64
ROUNDS = 3
_R, _Q = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)  # odd bases of rolling hashes


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(x: np.ndarray, base: U) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give a hash of any range (range_hash), modulo 2 ** 64."""
    inverse = U(pow(int(base), -1, 1 << 64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(base, len(x))[:-1], dtype=np.uint64)]), _powers(inverse, len(x))


def range_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[0][end] - sums[0][start]) * sums[1][start]


class Level:
    """Symbols of one level: name, first word, and the range of words that decides the symbol."""

    def __init__(self, name: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.start, self.low, self.high = name, start, low, high


def next_level(x: Level, round_: int) -> Level:
    """One round: runs, then pairs. What lies beyond the ends of the sequence is unknown, so symbols there are decided by
    words outside it (low -1, or high one too far)."""
    n = len(x.name)
    total = int(x.high[-1])
    # runs: a run is maximal because of its neighbours, which therefore decide it too
    first = np.ones(n, bool)
    first[1:] = x.name[1:] != x.name[:-1]
    at = np.flatnonzero(first)
    length = np.diff(np.append(at, n))
    name = np.where(length > 1, B.mixed(B.mixed(x.name[at] ^ U(0x52554E)) + length.astype(np.uint64)), x.name[at])
    low = np.concatenate([[-1], x.low[at[1:] - 1]])
    high = np.concatenate([x.high[at[1:]], [total + 1]])
    start = x.start[at]
    # pairs: a symbol of the left side joins a following one of the right side
    m = len(name)
    right = (B.mixed(name + U((round_ + 1) * int(_Q) % (1 << 64))) >> U(63)).astype(bool)
    joins = np.zeros(m, bool)  # with the next one
    joins[:-1] = ~right[:-1] & right[1:]
    second = np.concatenate([[False], joins[:-1]])
    head = np.flatnonzero(~second)
    paired = joins[head]
    after, before = np.minimum(head + 1, m - 1), np.maximum(head - 1, 0)
    new = np.where(paired, B.mixed(B.mixed(name[head] + _R) ^ name[after]), name[head])
    # a single symbol is decided by the neighbour it might have joined
    look_on, look_back = paired | ~right[head], ~paired & right[head]
    new_high = np.where(look_on, np.where(head + 1 < m, high[after], total + 1), high[head])
    new_low = np.where(look_back, np.where(head > 0, low[before], -1), low[head])
    return Level(new, start[head], np.minimum.accumulate(new_low[::-1])[::-1], np.maximum.accumulate(new_high))


def window_keys(words: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """The key of each window of `size` words of one sequence of word hashes."""
    n = len(words)
    place = np.arange(n)
    levels = [Level(words, place, place, place + 1)]
    for r in range(rounds):
        levels.append(next_level(levels[-1], r))
    count = n - size + 1
    sums = rolling(words, _Q)
    keys = np.zeros(max(0, count), np.uint64)
    todo = np.arange(max(0, count))
    for k in range(rounds, -1, -1):
        x = levels[k]
        i, j = np.searchsorted(x.low, todo, "left"), np.searchsorted(x.high, todo + size, "right")
        has = i < j
        windows, i, j = todo[has], i[has], j[has]
        todo = todo[~has]
        if not len(windows):
            continue
        rank = B.mixed(x.name ^ U(0x7069636B))
        best, pick = rank[i], i.copy()
        on = np.flatnonzero(i + 1 < j)
        step = 1
        while len(on):
            other = rank[i[on] + step]
            less = other < best[on]
            best[on[less]], pick[on[less]] = other[less], (i[on] + step)[less]
            step += 1
            on = on[i[on] + step < j[on]]
        low, high = x.low[pick], x.high[pick]
        keys[windows] = B.mixed(range_hash(sums, low, high) + (high - low).astype(np.uint64) * _R + U(k))
    return keys


class Parsed:
    """A block's words and windows. Documents are parted by separators that no window holds; each has a hash of its own,
    so that it joins no run. `name` is a hash of each window's words, `kinds` the distinct names in ascending order, `of` the
    place of each window's name in them, and `least` the smallest id (of `ids`) of a document that has it."""

    def __init__(self, texts: list[bytes], size: int, ids: np.ndarray | None = None):
        hashes, self.sizes = B.word_hashes(texts)
        n = len(texts)
        self.first = np.cumsum(self.sizes) - self.sizes + np.arange(n)  # of each document's words, separators counted
        total = len(hashes) + n
        mark = self.first + self.sizes
        inside = np.ones(total, bool)
        inside[mark] = False
        self.words = np.empty(total, np.uint64)
        self.words[inside] = hashes
        self.words[mark] = B.mixed(np.arange(n, dtype=np.uint64) + U(0x5345504152415445))
        full = np.concatenate([[0], np.cumsum(~inside)])
        self.size = size
        self.windows = np.flatnonzero(full[size:] == full[:-size]) if total >= size else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.first, self.windows, "right") - 1
        if ids is not None:
            name = B.mixed(range_hash(rolling(self.words, _R), self.windows, self.windows + size))
            order = np.argsort(name, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = name[order[1:]] != name[order[:-1]]
            starts = np.flatnonzero(new)
            self.kinds, self.one = name[order[starts]], order[starts]
            self.of = np.empty(len(order), np.int64)
            self.of[order] = np.cumsum(new) - 1
            self.owner = ids[self.doc]
            self.least = np.minimum.reduceat(self.owner[order], starts) if len(starts) else self.owner

    def keys(self) -> np.ndarray:
        return window_keys(self.words, self.size)[self.windows] if len(self.windows) else np.zeros(0, np.uint64)

    def more(self, places: np.ndarray) -> np.ndarray:
        """32 further bits of the words of the windows at these places."""
        at = self.windows[places]
        return (B.mixed(range_hash(rolling(B.mixed(self.words ^ _Q), _Q), at, at + self.size)) >> U(32)).astype(np.uint32)


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])


def dedup(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: `row`, a struct of all its columns but the text, n_words, n_removed, kept (the text if
    nothing is removed, else the kept words joined by one space) and kept_sha256 (of the kept words joined by one space).
    A word goes if a window of `size` words around it also starts in a document with a smaller id; windows are judged on
    the input. Words lie between ASCII white space. Null texts have none; rows without an id come after all others, and
    rows that share an id don't remove from each other. A task holds one block, or one text that is longer, at about 100
    bytes a word."""
    carried = docs.drop(text_col)
    blocks = B.make_blocks(docs, id_col, text_col, carried.columns)
    n = B.n_buckets(blocks)

    def key_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = Parsed(texts, size)
        return p.keys(), p.doc

    classes = B.frequency_classes(blocks, key_of, n, "symbol-classes")

    def candidates(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """For each bucket: which of the block's distinct windows in it may be repeats, their names, 32 bits more, and the
        smallest id that has them in this block. However often a block has a window, it is sent once."""
        ids, _, texts = B.unpacked(block.iloc[0])
        p = Parsed(texts, size, ids)
        keys = p.keys()[p.one]
        kinds, place = np.unique(keys, return_inverse=True)
        may = B.classes_of(kinds, answers, n)[place] > 0
        found, starts, _ = B.by_bucket(p.kinds, n)
        further = np.zeros(len(may), np.uint32)
        further[may] = p.more(p.one[may])
        out = []
        for k, a, b in zip(found.tolist(), starts, starts[1:], strict=False):
            on = np.flatnonzero(may[a:b]) + a
            if len(on):
                owners, which = np.unique(p.least[on], return_inverse=True)
                out.append((k, B.joined(B.number(b - a), np.packbits(may[a:b]).tobytes(), B.packed(p.kinds[on], 5), further[on].tobytes(), owners.tobytes(), B.packed(which.astype(np.uint32), 0))))
        number = block["block"].iloc[0]
        del p, keys, kinds, place
        trim()
        return pd.DataFrame({"bucket": np.array([k for k, _ in out], np.int32), "block": np.full(len(out), number), "body": [x for _, x in out]})

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """For each block, which of its distinct windows in the bucket a document with a smaller id has in another block."""
        masks, names, further, owner = [], [], [], []
        for body in rows["body"]:
            total, may, kinds, bits, owners, which = B.parted(body)
            masks.append(np.unpackbits(np.frombuffer(may, np.uint8), count=int.from_bytes(total, "little")).astype(bool))
            m = int(masks[-1].sum())
            names.append(B.unpack(kinds, m, 5, np.uint64))
            further.append(np.frombuffer(bits, np.uint32))
            owner.append(np.frombuffer(owners, np.int64)[B.unpack(which, m, 0, np.uint32)])
        ends = np.cumsum([len(x) for x in names]).tolist()
        h, g, o = np.concatenate(names), np.concatenate(further), np.concatenate(owner)
        order = np.lexsort((g, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        least = np.minimum.reduceat(o[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        goes = np.zeros(len(order), bool)
        goes[order] = o[order] > least
        del h, g, o, new, least, order
        out = []
        for mask, a, b in zip(masks, [0, *ends], ends, strict=False):
            all_ = np.zeros(len(mask), bool)
            all_[mask] = goes[a:b]
            out.append(np.packbits(all_).tobytes())
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "body": out})

    sent = blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInPandas(candidates, "bucket int, block long, body binary")
    repeats = B.settled(sent.groupBy("bucket").applyInPandas(verify, "block long, bucket int, body binary"), "repeats")

    def remove(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        ids, _, texts = B.unpacked(row)
        p = Parsed(texts, size, ids)
        found, starts, _ = B.by_bucket(p.kinds, n)
        back = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True))
        gone = np.zeros(len(p.kinds), bool)
        for k, a, b in zip(found.tolist(), starts, starts[1:], strict=False):
            if k in back:
                gone[a:b] = np.unpackbits(np.frombuffer(back[k], np.uint8), count=int(b - a))
        at = p.windows[gone[p.of] | (p.owner > p.least[p.of])] if len(p.windows) else p.windows
        step = np.bincount(at, minlength=len(p.words) + 1) - np.bincount(at + size, minlength=len(p.words) + 1)
        cut = np.cumsum(step[:-1]) > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(cut)])[np.append(p.first, len(cut))]).tolist()
        first, sizes = p.first.tolist(), p.sizes.tolist()
        del p, gone, at, step
        out = []
        for i, text in enumerate(texts):
            words = text.split()
            if removed[i]:
                own = cut[first[i] : first[i] + sizes[i]].tolist()
                words = [w for w, c in zip(words, own, strict=True) if not c]
            kept = b" ".join(words)
            out.append((sizes[i], removed[i], (kept if removed[i] else text).decode(), hashlib.sha256(kept).hexdigest()))
        trim()
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.Table.from_arrays([B.carried(row), *columns], ["row", *RESULT.names])

    schema = T.StructType([T.StructField("row", carried.schema), *RESULT])
    return blocks.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(remove, schema)
