"""Documents in blocks, and an exchange of packed keys between blocks and buckets.

A block is a row that holds a few MB of documents, compressed. Statistics over all words or shingles of a corpus go through
many small numbers; here each block sends each bucket of hash values one row with all its numbers packed into bytes, and a
bucket answers each block with one row. The blocks are a written table, so both ways see the same blocks after any failure.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.common import bucketed, slices, trim, written

BLOCK_BYTES = 2 << 20
#: Text bytes for each bucket: what a bucket's task holds stays the same at any size of the corpus.
BUCKET_BYTES = 6 << 20
#: Of the 32 bits that tell a bucket's keys apart, so many aren't sent: some in a thousand keys then look like another one.
REST = 4
#: Stands for a null id: no document comes after it.
NO_ID = (1 << 63) - 1
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def make_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """block, n_bytes, ids, no_id (1 where the id is null), sizes (-1 for a null text), texts, compressed, and `rest`: the
    columns to carry, as an Arrow stream of one struct column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, "text", BLOCK_BYTES):
            texts, ids = part.column("text").to_pylist(), part.column("id")
            raw = b"".join(t or b"" for t in texts)
            sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            keys = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
            none = np.array(ids.is_null(), np.uint8)
            rest = b""
            if carry:
                own = pa.RecordBatch.from_arrays([part.column("row")], ["row"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as stream:
                    stream.write_batch(own)
                rest = pack.compress(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(raw)], pa.int64()), *(pa.array([x], pa.binary()) for x in (keys.tobytes(), none.tobytes(), sizes.tobytes(), pack.compress(raw), rest))], ["n_bytes", "ids", "no_id", "sizes", "texts", "rest"])
        trim()

    more = [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *more)
    whole = rows.mapInArrow(run, "n_bytes long, ids binary, no_id binary, sizes binary, texts binary, rest binary")
    return bucketed(whole.withColumn("block", F.monotonically_increasing_id()), "block", "blocks")


def unpacked(row) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """ids, which of them are null, and texts (empty for null) of a block."""
    sizes = np.maximum(np.frombuffer(row["sizes"], np.int64), 0)
    raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(row["n_bytes"])))
    ends = np.cumsum(sizes).tolist()
    texts = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], np.uint8) > 0, texts


def carried(row) -> pa.Array:
    """The carried columns of a block."""
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(row["rest"])) as stream:
        return stream.read_all().column("row").combine_chunks()


def n_buckets(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(16, math.ceil(total / BUCKET_BYTES))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
#: Bytes that are hashed at a time, and from which length on a word is hashed by itself.
PART, LONG = 1 << 16, 1 << 10
_BASE = 0x9FB21C651E98DF25
_UP, _DOWN = _powers(_BASE, PART + LONG), _powers(pow(_BASE, -1, 1 << 64), PART + LONG)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text by text, and the number of each text's words. Words lie between ASCII white space.
    A word's hash is a polynomial of its bytes modulo 2 ** 64, got from prefix sums over many words at once."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = np.concatenate([[True], _SPACES[raw]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    length = ends - starts
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(length > LONG)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    for first, last in zip(np.append(0, long + 1).tolist(), np.append(long, len(starts)).tolist(), strict=True):
        while first < last:
            at = int(starts[first])
            stop = min(last, int(np.searchsorted(starts, at + PART)))
            end = int(ends[stop - 1])
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(_BYTES[raw[at:end]] * _UP[: end - at], out=sums[1:])
            s = starts[first:stop] - at
            out[first:stop] = (sums[ends[first:stop] - at] - sums[s]) * _DOWN[s]
            first = stop
    return mixed(out + length.astype(np.uint64) * U(0xD6E8FEB86659FD93)), sizes


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that ascending keys fall into, the first place of each (and the end), and 32 bits that tell the keys of a
    bucket apart, in their order: together log2(n) + 32 bits, so more buckets tell more keys apart."""
    place = (keys >> U(32)) * U(n) + (((keys & U(0xFFFFFFFF)) * U(n)) >> U(32))
    found, starts = np.unique(place >> U(32), return_index=True)
    return found.astype(np.int64), np.append(starts, len(keys)), place.astype(np.uint32)


def packed(x: np.ndarray, plain: int) -> bytes:
    """Unsigned integers as the differences of neighbours, by byte planes: the `plain` lowest ones as they are, the others,
    which are much alike if the integers ascend, compressed."""
    planes = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T)
    return planes[:plain].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[plain:].tobytes())


def unpack(body: bytes, n: int, plain: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    low = np.frombuffer(body, np.uint8, plain * n).reshape(plain, n)
    high = zstandard.ZstdDecompressor().decompress(body[plain * n :], max_output_size=max(1, (width - plain) * n))
    planes = np.concatenate([low, np.frombuffer(high, np.uint8).reshape(width - plain, n)])
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def joined(*parts: bytes) -> bytes:
    """Byte strings in one, to be told apart by parted()."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def parted(body: bytes) -> list[bytes]:
    n = int(np.frombuffer(body, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(body, "<u4", n, 4)) + 4 * (n + 1)
    return [body[a:b] for a, b in zip([4 * (n + 1), *ends.tolist()], ends.tolist(), strict=False)]


def number(n: int) -> bytes:
    return int(n).to_bytes(4, "little")


Keys = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def distinct_counts(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block in ascending order, and in how many of its documents each is; `docs` ascends."""
    if len(keys):  # neighbours are often equal
        new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
        keys, docs = keys[new], docs[new]
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    new = first.copy()
    new[1:] |= d[1:] != d[:-1]  # a document counts once
    starts = np.flatnonzero(first)
    return k[starts], np.add.reduceat(new.astype(np.uint32), starts, dtype=np.uint32) if len(starts) else np.zeros(0, np.uint32)


def frequency_classes(blocks: DataFrame, keys_of: Keys, n: int, name: str) -> DataFrame:
    """For each block and bucket, the class of each of the block's distinct keys in that bucket, in ascending order of the
    keys: 0 if one document alone has the key, else 1 + floor(8 * log2(documents / 2)), 255 at most. keys_of(texts): keys
    (64 bits) and the number of the text of each, ascending. Equal rests of different keys in one bucket may raise a
    class, alike for all who ask."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kinds, count = distinct_counts(*keys_of(unpacked(row)[2]))
                found, starts, rest = by_bucket(kinds, n)
                bodies = [joined(number(b - a), packed(rest[a:b] >> np.uint32(REST), 2), packed(count[a:b], 0)) for a, b in zip(starts, starts[1:], strict=False)]
                trim()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([row["block"]] * len(found), pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for body in rows["body"]:
            size, key, count = parted(body)
            m = int.from_bytes(size, "little")
            keys.append(unpack(key, m, 2, np.uint32))
            counts.append(unpack(count, m, 0, np.uint32))
        sizes = [len(k) for k in keys]
        kinds, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts))
        level = np.where(total < 2, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(total, 2) / 2)))).astype(np.uint8)[at]
        ends = np.cumsum(sizes).tolist()
        del keys, counts, kinds, at, total
        trim()
        pack = zstandard.ZstdCompressor(level=1)
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "body": [pack.compress(level[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)]})

    sent = blocks.mapInArrow(send, "bucket int, block long, body binary")
    return settled(sent.groupBy("bucket").applyInPandas(answer, "block long, bucket int, body binary"), name)


def classes_of(kinds: np.ndarray, answers: pd.DataFrame, n: int) -> np.ndarray:
    """The classes of a block's distinct keys from the answers of its buckets."""
    found, starts, _ = by_bucket(kinds, n)
    back = dict(zip(answers["bucket"].tolist(), answers["body"], strict=True))
    open_ = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(open_.decompress(back[k], max_output_size=int(b - a)), np.uint8) for k, a, b in zip(found.tolist(), starts, starts[1:], strict=False)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def settled(df: DataFrame, name: str) -> DataFrame:
    """written(), after which the shuffle files that led to it can go: the driver's garbage is collected, for Spark drops a
    shuffle's files once nothing refers to it any more."""
    out = written(df, name)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out
