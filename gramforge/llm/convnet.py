"""Quality by a convolutional network over bytes, in numpy.

Learned filters slide over the bytes' embeddings; their rectified answers are max-pooled over chunks of the document that
overlap by half and together cover all of it. A small layer turns each chunk's pooled answers into evidence of junk, the
document's evidence is the largest of its chunks', and a logistic function makes it the probability of good quality. The
answers are computed once for each byte position and pooled over half chunks; a chunk is two neighbouring halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.common import crc_mod, labelled_sample, slices

#: Bytes of a filter, bytes between its positions, positions in half a chunk, and sizes of the layers.
WIDTH, STRIDE, HALF, EMBED, FILTERS, HIDDEN = 8, 2, 64, 8, 64, 24
#: The labelled texts that the network is fitted on: at most so many of each class, and so many bytes together.
PER_CLASS, MAX_BYTES = 4000, 10 << 20
EPOCHS, BATCH, RATE, SEED, SHORT_SHARE = 9, 24, 0.004, 7, 0.2
PAD = 256
#: Positions at a text's end from which a filter would reach into the next text.
BEYOND = (WIDTH - 1) // STRIDE


@dataclass
class Net:
    embed: np.ndarray  # 257 x EMBED; the last row stands for what lies behind the end
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1


def new_net(rng: np.random.Generator) -> Net:
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return Net(f(257, EMBED, scale=0.5), f(WIDTH * EMBED, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), f(FILTERS, HIDDEN, scale=0.25), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.25), np.zeros(1, np.float32))


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes one after the other, each filled up with PAD to whole half chunks (two at least) so that a filter's
    width of PAD ends it, and the number of half chunks of each."""
    step = HALF * STRIDE
    halves = np.array([max(2, -(-(len(t) + WIDTH) // step)) for t in texts], np.int64)
    codes = np.full(int(halves.sum()) * step + WIDTH, PAD, np.int16)
    at = 0
    for t, n in zip(texts, halves.tolist(), strict=True):
        codes[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * step
    return codes, halves


def windows(net: Net, codes: np.ndarray) -> np.ndarray:
    """The embedded bytes under the filters at each position (a view)."""
    x = net.embed[codes]
    n = (len(codes) - WIDTH) // STRIDE
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * x.strides[0], x.itemsize))


def pooled(net: Net, codes: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """The filters' largest answers in each half chunk, before the bias, positions that reach into the next text left out.
    Bytes are embedded some half chunks at a time, so a
    text of any length takes little more than its bytes."""
    n = (len(codes) - WIDTH) // STRIDE // HALF
    out = np.empty((n, FILTERS), np.float32)
    last = np.zeros(n, bool)
    last[np.cumsum(halves) - 1] = True
    for a in range(0, n, 512):
        b = min(n, a + 512)
        x = windows(net, codes[a * HALF * STRIDE : b * HALF * STRIDE + WIDTH])
        answers = (np.ascontiguousarray(x) @ net.filters).reshape(b - a, HALF, FILTERS)
        answers[last[a:b], HALF - BEYOND :] = -np.inf
        out[a:b] = answers.max(1)
    return out


def chunk_rows(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first half of each chunk, and where each document's chunks start: n halves make n - 1 overlapping chunks."""
    ends = np.cumsum(halves)
    first = np.ones(int(ends[-1]), bool)
    first[ends - 1] = False
    return np.flatnonzero(first), np.cumsum(halves - 1) - (halves - 1)


def evidence(net: Net, best: np.ndarray, halves: np.ndarray):
    """Junk logits of the chunks and what the backward pass needs."""
    first, starts = chunk_rows(halves)
    top = np.maximum(best[first], best[first + 1])
    a = np.maximum(top + net.bias, 0)
    h = np.maximum(a @ net.hidden + net.hidden_bias, 0)
    return h @ net.out + net.out_bias, h, a, first, starts


def predict(net: Net, texts: list[bytes]) -> np.ndarray:
    """The probability of good quality of each text."""
    if not texts:
        return np.zeros(0)
    codes, halves = padded(texts)
    z, _, _, _, starts = evidence(net, pooled(net, codes, halves), halves)
    worst = np.maximum.reduceat(z, starts).astype(np.float64)
    return 1 / (1 + np.exp(np.clip(worst, -30, 30)))


def gradients(net: Net, texts: list[bytes], good: np.ndarray, weight: np.ndarray) -> tuple[float, Net]:
    """Loss and its gradient: only each document's worst chunk has one, and in it each filter's best position."""
    codes, halves = padded(texts)
    best = pooled(net, codes, halves)
    z, h, a, first, starts = evidence(net, best, halves)
    ends = starts + halves - 1
    pick = np.array([s + int(np.argmax(z[s:e])) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    p_bad = 1 / (1 + np.exp(-np.clip(z[pick], -30, 30)))
    bad = 1 - good
    loss = float(-(weight * (bad * np.log(p_bad + 1e-7) + good * np.log(1 - p_bad + 1e-7))).mean())
    dz = ((p_bad - bad) * weight / len(texts)).astype(np.float32)
    dh = dz[:, None] * net.out * (h[pick] > 0)
    da = (dh @ net.hidden.T) * (a[pick] > 0)
    rows = first[pick]
    at = rows[:, None] * HALF + np.arange(2 * HALF)  # the chunk's positions
    x = np.ascontiguousarray(windows(net, codes)[at.ravel()])
    answers = (x @ net.filters).reshape(len(pick), 2 * HALF, FILTERS)
    answers[pick == ends - 1, 2 * HALF - BEYOND :] = -np.inf
    where = answers.argmax(1)  # documents x FILTERS
    x = x.reshape(len(pick), 2 * HALF, -1)
    under = np.take_along_axis(x, where[:, :, None], 1)  # documents x FILTERS x inputs
    d_filters = np.einsum("df,dfi->if", da, under, optimize=True)
    dx = (da[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, EMBED)
    byte_at = (np.take_along_axis(at, where, 1) * STRIDE).ravel()[:, None] + np.arange(WIDTH)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, codes[byte_at].ravel(), dx.reshape(-1, EMBED))
    return loss, Net(d_embed, d_filters, da.sum(0), a[pick].T @ dh, dh.sum(0), h[pick].T @ dz, np.array([dz.sum()], np.float32))


def fit(sample: list[tuple[bytes, int]], epochs: int = EPOCHS) -> Net:
    """Adam over the sample in a seeded order, both classes with the same weight. Without both classes every text scores the share of good ones."""
    rng = np.random.default_rng(SEED)
    net = new_net(rng)
    y = np.array([s[1] for s in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        share = float(y.mean()) if len(y) else 0.5
        net.out_bias[:] = np.log((1 - share + 1e-6) / (share + 1e-6))
        return net
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    names = [f.name for f in fields(Net)]
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    steps, t = epochs * -(-len(sample) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            texts = [sample[i][0] for i in own]
            for k, i in enumerate(own.tolist()):  # a piece of a good text is good too: short texts are rare in a sample
                if y[i] == 1 and rng.random() < SHORT_SHARE and len(texts[k]) > 20:
                    n = int(rng.integers(10, 200))
                    start = int(rng.integers(0, max(1, len(texts[k]) - n)))
                    texts[k] = texts[k][start : start + n]
            _, g = gradients(net, texts, y[own], balance[own])
            t += 1
            rate = RATE * (0.1 + 0.9 * (1 - t / steps))
            for k in names:
                d = getattr(g, k)
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                getattr(net, k)[...] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return net


def fit_on(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Net:
    """The network from a bounded sample of labelled rows whose id fulfils `learn`; see common.labelled_sample."""
    return fit(labelled_sample(docs, labels, label, learn, id_col, text_col, per_class, max_bytes))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: better) of every row from its whole text; null is scored as the empty text. Null ids
    and repeated rows are kept, other columns are not carried. No shuffle; the network's size is fixed."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            got = predict(shipped.value, [x or b"" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op2's columns: learning from rows whose crc32(doc_id) mod 5 isn't 0, on which held_out is false. A row without a
    doc_id is not held out, for it has no label either."""
    net = fit_on(docs, labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0)
    return score(docs, net).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
