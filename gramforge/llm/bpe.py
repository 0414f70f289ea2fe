"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a piece has exactly one encoding, so the last token of that encoding describes it: the encoding of the
prefix is that token after the encoding of what comes before the token. A token may follow another exactly if merging
the bytes of the two by rank gives the two again, which is looked up once for each pair. Going through the prefixes in
order, each stored token opens the tokens that start where it ends, so that nothing is ever merged over a whole piece.
As prefixes keep their tokens, appended bytes only add entries, and after an edit only entries from the edit on are
computed, until they agree with the old ones for longer than any token.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.common import slices, trim

#: Bytes in each generation of a cache of encoded pieces, besides what one slice brings; bounds memory and decides nothing else.
CACHE_BYTES = 8 << 20
#: Bytes of text that are encoded at once: what a slice's pieces take on the way is some forty times as much.
SLICE_BYTES = 1 << 20
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixBPE:
    """Ranks as id by bytes, each single byte among them. encode_piece() gives what merging by lowest rank gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        self.starts: dict[bytes, int] = {}  # prefixes of tokens: the token's id, or -1
        for token, i in ranks.items():
            self.vocab[i] = token
            for k in range(1, len(token)):
                self.starts.setdefault(token[:k], -1)
            self.starts[token] = i
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})

    def merged(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, the first of equal ones, until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose joining makes t last; (t, -1) for a byte, None if merging t's bytes doesn't give t."""
        known = self.split.get(t, 0)
        if known == 0:
            data, known = self.vocab[t], (t, -1)
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                    if rank == 1 << 62:
                        break
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                known = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.split[t] = known
        return known

    def spine(self, t: int, side: int) -> list[int] | None:
        """The tokens at t's right (1) or left (0) end while its bytes are merged, the first byte's token first."""
        known = self.spines[side].get(t, 0)
        if known == 0:
            known, x = [t], t
            while (two := self.halves(x)) and two[1] >= 0:
                x = two[side]
                known.append(x)
            known = self.spines[side][t] = known[::-1] if two else None
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged together, give a and b. Ranks of merges never fall in time, so it is
        enough to look at the tokens that meet at the border: they must not join before one of them grows inwards."""
        left, right = self.spine(a, 1), self.spine(b, 0)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            join = self.ranks.get(self.vocab[left[i]] + self.vocab[right[j]], 1 << 62)
            inner_a = left[i + 1] if i + 1 < len(left) else 1 << 62
            inner_b = right[j + 1] if j + 1 < len(right) else 1 << 62
            if join < inner_a and join <= inner_b:
                return False
            if inner_a == inner_b == 1 << 62:
                return True
            if inner_a <= inner_b:  # of equal ranks the left one goes first
                i += 1
            else:
                j += 1

    def alone(self, t: int) -> bool:
        return self.spine(t, 0) is not None

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fills last[i] (the last token of the prefix of i bytes) where it is -1, from the entries before; `start`: the
        first prefix whose following tokens may be missing."""
        get, pairs, n = self.starts.get, self.pairs, len(data)
        for j in range(start, n):
            before = last[j]
            if j and before < 0:
                continue
            for e in range(j + 1, n + 1):
                t = get(data[j:e])
                if t is None:
                    break
                if t >= 0 and last[e] < 0:
                    if j:
                        known = pairs.get(before << 32 | t)
                        if known is None:
                            known = pairs[before << 32 | t] = self.may_follow(before, t)
                    else:
                        known = self.alone(t)
                    if known:
                        last[e] = t

    def prefixes(self, data: bytes) -> list[int]:
        last = [-1] * (len(data) + 1)
        self.extend(data, last, 0)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.vocab[last[i]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read_back(self.prefixes(data))

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of data + more from that of data: the old entries stay as they are."""
        data, last = data + more, last + [-1] * len(more)
        self.extend(data, last, max(0, len(data) - len(more) - self.longest + 1))
        return data, last

    def edit(self, data: bytes, last: list[int], at: int, removed: int, inserted: bytes) -> tuple[bytes, list[int]]:
        """The table after data[at:at + removed] gives way to `inserted`. Entries up to `at` stay; behind the edit, new
        entries are computed until they equal the old ones over the longest token's length, then the old ones follow."""
        new = data[:at] + inserted + data[at + removed :]
        shift, tail = len(inserted) - removed, at + len(inserted)
        out = last[: at + 1] + [-1] * (len(new) - at)
        agreed, j, done = 0, max(0, at - self.longest + 1), at
        while done < len(new):
            step = min(len(new), max(done + 4 * self.longest, tail))
            self.extend(new[:step], out, j)
            for i in range(done + 1, step + 1):
                agreed = agreed + 1 if i > tail and out[i] == last[i - shift] else 0
                if agreed > self.longest:
                    return new, out[: i + 1] + last[i - shift + 1 :]
            done, j = step, max(0, step - self.longest + 1)
        return new, out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class Table:
    """Open addressing from non-negative 64-bit keys to numbers, looked up and filled by whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 for unknown keys."""
        out, slot, todo = np.full(len(keys), -1, np.int32), self._slot(keys), np.arange(len(keys))
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        if (self.n + len(keys)) * 3 > 1 << self.bits:
            old, kept = self.keys >= 0, self.n
            more, both = len(keys), (self.keys[old], self.values[old])
            self.__init__(max(self.bits + 1, int(np.ceil(np.log2(3 * (kept + more))))))
            self.put(*both)
        self.n += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            at, first = np.unique(slot[free], return_index=True)
            took = free[first]
            self.keys[at], self.values[at] = keys[took], values[took]
            left = np.ones(len(keys), bool)
            left[took] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)


class ManyPieces:
    """PrefixBPE's table for many pieces at once: the pieces advance together, one prefix after the other, through a trie
    of the tokens held in a Table."""

    LONG = 48  # longer pieces go through PrefixBPE one by one

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe
        edges: dict[int, int] = {}
        token = [-1]
        for data, t in bpe.ranks.items():
            node = 0
            for c in data:
                node = edges.setdefault(node << 8 | c, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        self.token = np.array(token, np.int32)
        self.edges = Table(4)
        self.edges.put(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.pairs = Table()
        self.alone = np.array([bpe.alone(t) for t in range(len(bpe.vocab))])

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        known = self.pairs.get(keys)
        if (new := known < 0).any():
            fresh = np.unique(keys[new])
            self.pairs.put(fresh, np.array([self.bpe.may_follow(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], np.int32))
            known[new] = self.pairs.get(keys[new])
        return known > 0

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as bytes."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(size > self.LONG).tolist():
            out[i] = np.array(self.bpe.encode_piece(pieces[i]), "<u4").tobytes()
        order = np.flatnonzero(size <= self.LONG)
        order = order[np.argsort(-size[order], kind="stable")]  # the longest first: those still running are a prefix
        if not len(order):
            return out
        size = size[order]
        data = np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8)
        at = np.cumsum(size) - size
        most = int(size[0])
        last = np.full((most + 1, len(order)), -1, np.int32)
        for j in range(most):
            rows = np.arange(np.searchsorted(-size, -j, "left"))  # size > j
            node, e = np.zeros(len(rows), np.int64), j
            while len(rows):
                node = self.edges.get(node << 8 | data[at[rows] + e])
                go = node >= 0
                rows, node, e = rows[go], node[go].astype(np.int64), e + 1
                t = self.token[node]
                may = np.flatnonzero((t >= 0) & (last[e, rows] < 0))
                if len(may):
                    good = self.follows(last[j, rows[may]], t[may]) if j else self.alone[t[may]]
                    last[e, rows[may[good]]] = t[may[good]]
                go = size[rows] > e
                rows, node = rows[go], node[go]
        width = np.array([len(x) for x in self.bpe.vocab], np.int64)
        left, rows, back = size.copy(), np.arange(len(order)), []
        while len(rows):
            t = last[left[rows], rows]
            back.append((rows, t))
            left[rows] -= width[t]
            rows = rows[left[rows] > 0]
        row, ids = (np.concatenate(x) for x in zip(*back[::-1], strict=True))
        turn = np.argsort(row, kind="stable")
        ids, ends = ids[turn].astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(row, minlength=len(order)))
        start = 0
        for i, end in zip(order.tolist(), ends.tolist(), strict=True):
            whole = self.bpe.ranks.get(pieces[i])
            out[i] = ids[start:end] if whole is None else whole.to_bytes(4, "little")
            start = end
        return out


class Recent:
    """A cache of two generations: a full one becomes the old one, and what is used again moves to the new one. One that a
    slice has filled more than twice (a long text) is dropped."""

    ENTRY = 100  # bytes in the dictionary, about

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def missing(self, keys: set[str]) -> list[str]:
        """Those of the keys that neither generation has; the others are in `now` after this."""
        if self.size > CACHE_BYTES:
            self.now, self.old, self.size = {}, self.now if self.size <= 2 * CACHE_BYTES else {}, 0
        keys.difference_update(self.now)
        again = [k for k in keys if k in self.old]
        self.add(again, map(self.old.__getitem__, again))
        keys.difference_update(again)
        return list(keys)

    def add(self, keys: list[str], values: Iterable[bytes]) -> None:
        """Keys that `now` doesn't have."""
        values = list(values)
        self.now.update(zip(keys, values, strict=True))
        self.size += sum(map(sys.getsizeof, keys)) + sum(map(sys.getsizeof, values)) + self.ENTRY * len(keys)


class Tokenizer:
    """Pieces by a pattern, each encoded separately; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = PrefixBPE(ranks)
        self.many = ManyPieces(self.bpe)
        self.pieces = regex.compile(pattern).findall
        self.by_piece = Recent()
        self.by_chunk = Recent()
        self.space_run = regex.compile(r" (?:\s|$)").search

    def forget(self) -> None:
        """Empties the caches."""
        self.by_piece, self.by_chunk = Recent(), Recent()

    def learn(self, pieces: set[str]) -> None:
        new = self.by_piece.missing(pieces)
        self.by_piece.add(new, self.many.encode([p.encode() for p in new]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For the pattern of public_tokenizers, which starts a piece at every single space before a character that isn't
        white space: the chunks between such spaces are looked up whole. Texts with other spaces are cut by the pattern."""
        plain: list[list[str] | None] = [None if x[:1].isspace() or self.space_run(x) else x.split(" ") for x in texts]
        cut = [self.pieces(x) if p is None else self.pieces(p[0]) for x, p in zip(texts, plain, strict=True)]
        fresh = self.by_chunk.missing(set().union(*(p[1:] for p in plain if p)))
        found = self.pieces(" " + " ".join(fresh)) if fresh else []
        self.learn(set(found).union(*cut))
        one = self.by_piece.now.__getitem__
        ids = list(map(one, found))
        starts = [i for i, p in enumerate(found) if p[0] == " "] + [len(found)]
        self.by_chunk.add(fresh, (ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(starts, starts[1:], strict=False)))
        chunk = self.by_chunk.now.__getitem__
        return [b"".join(map(one, c)) + (b"".join(map(chunk, p[1:])) if p else b"") for c, p in zip(cut, plain, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(ids, "<u4").tolist())


def ranks_from(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python worker. The vocabulary is installed with its library on every machine."""
    return Tokenizer(ranks_from(path), pattern)


def encoded(batches: Iterator[pa.RecordBatch], t: Tokenizer, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Batches of id and text as batches of what encode_documents() gives, a slice of the texts at a time."""
    for part in slices(batches, "text", SLICE_BYTES):
        out = []
        for ids in t.encode_all([x or "" for x in part.column("text").to_pylist()]):
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest(), *([ids] if with_ids else [])))
        n, a, b, *more = zip(*out, strict=True)
        arrays = [part.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *(pa.array(x, pa.binary()) for x in more)]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs, repeated rows and null ids included: id, n_tokens, SHA-256 of the ids and of the
    bytes that the ids decode to; with_ids: also the ids, as binary column `ids`. A null or empty text has no tokens.
    Other columns are not carried, so their names cannot clash. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        yield from encoded(batches, t, with_ids)
        t.forget()
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, {SCHEMA}" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)
