"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Each class (toxic, ordinary) has counts of the characters that follow each five; both back off to one shared model of
lower order, whose continuation counts come from the two classes together. An expression that a class has rarely or
never seen thus gets the shared probability, and neither class gains from it. What a text scores by is the difference
of the two log-likelihoods, normalised by length, over the whole text and over its words: a toxic text holds a few toxic
words among ordinary ones. A logistic function fitted on labelled texts makes it a probability.

A character whose five predecessors were never seen in training contributes 0. If the predecessors were seen but not
with this character, the shared probability cancels and the difference depends on the predecessors alone. So the whole
model is two tables: differences by six characters, and by five.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.common import crc_mod, labelled_sample, slices, trim

ORDER = 6
#: The labelled texts that the model is fitted on: at most so many of each class, and so many bytes together.
PER_CLASS, MAX_BYTES = 4000, 10 << 20
#: Entries of a worker's cache of scored words; bounds memory only.
CACHE = 400_000
SCORE_SCHEMA = "id long, score double"
_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class KneserNey:
    grams: np.ndarray  # sorted keys of six characters
    gram_llr: np.ndarray
    contexts: np.ndarray  # sorted keys of five
    context_llr: np.ndarray
    weights: np.ndarray  # of the features, the bias last


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _discounts(counts: Counter) -> float:
    by = Counter(counts.values())
    return by[1] / (by[1] + 2 * by[2]) if by[1] and by[2] else 0.5


def gram_counts(words: Counter) -> Counter:
    """Counts of six characters: a word starts behind ORDER - 1 zeros and ends with a space."""
    out: Counter = Counter()
    pad = "\0" * (ORDER - 1)
    for w, n in words.items():
        s = f"{pad}{w} "
        for i in range(len(w) + 1):
            out[s[i : i + ORDER]] += n
    return out


def shared_model(types: set[str]):
    """Interpolated Kneser-Ney of all lower orders from the distinct grams of both classes: P(x | h) for h of any length."""
    levels = []
    grams = types
    for _ in range(ORDER - 1):
        follow = Counter(g[1:] for g in grams)  # in how many contexts each shorter gram continues
        total, kinds = Counter(), Counter()
        for g, n in follow.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        levels.append((follow, total, kinds, _discounts(follow)))
        grams = set(follow)
    alphabet = len(grams) + 1

    def p(gram: str, level: int = 0) -> float:
        if level == len(levels):
            return 1 / alphabet
        follow, total, kinds, d = levels[level]
        h = gram[:-1]
        lower = p(gram[1:], level + 1)
        if not total[h]:
            return lower
        return (max(follow[gram] - d, 0) + d * kinds[h] * lower) / total[h]

    return p


def keys_of(strings: list[str]) -> np.ndarray:
    """64-bit keys of strings of one length."""
    if not strings:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").reshape(len(strings), -1).astype(np.uint64)
    key = np.zeros(len(strings), np.uint64)
    for i in range(codes.shape[1]):
        key = (key ^ codes[:, i]) * _M
        key ^= key >> np.uint64(29)
    return key


def fit_counts(toxic: Counter, ordinary: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts = [gram_counts(toxic), gram_counts(ordinary)]
    discount = [_discounts(c) for c in counts]
    total, kinds = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for k in (0, 1):
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
    types = set(counts[0]) | set(counts[1])
    shared = shared_model(types)

    def backoff(k: int, h: str) -> float:
        return discount[k] * kinds[k][h] / total[k][h] if h in total[k] else 1.0

    def own(k: int, g: str) -> float:
        h = g[:-1]
        return (max(counts[k][g] - discount[k], 0) / total[k][h] if h in total[k] else 0.0) + backoff(k, h) * shared(g[1:])

    grams = sorted(types)
    contexts = sorted({g[:-1] for g in types})
    gram_llr = np.array([np.log(own(0, g) / own(1, g)) for g in grams])
    context_llr = np.array([np.log(backoff(0, h) / backoff(1, h)) for h in contexts])
    kg, kc = keys_of(grams), keys_of(contexts)
    a, b = np.argsort(kg), np.argsort(kc)
    return kg[a], gram_llr[a], kc[b], context_llr[b]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


def word_scores(model: KneserNey, words: list[str]) -> np.ndarray:
    """The difference of log-likelihoods of each word, its end included."""
    codes = np.frombuffer((" ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    pos = np.arange(len(codes)) - np.repeat(starts, sizes)
    key = np.zeros(len(codes), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        c = codes if not back else np.where(pos >= back, np.concatenate([np.zeros(min(back, len(codes)), np.uint64), codes[:-back]])[: len(codes)], np.uint64(0))
        if not back:
            context = key
        key = (key ^ c) * _M
        key ^= key >> np.uint64(29)
    llr, hit = _look_up(model.grams, model.gram_llr, key)
    miss = np.flatnonzero(~hit)
    llr[miss] = _look_up(model.contexts, model.context_llr, context[miss])[0]
    return np.add.reduceat(llr, starts)


class Scorer:
    """Scores texts; words seen before are looked up."""

    def __init__(self, model: KneserNey):
        self.model, self.seen = model, {}

    def features(self, texts: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen.clear()
        split = [words_of(x) for x in texts]
        new = set().union(*split)
        new.difference_update(self.seen)
        if new := sorted(new):
            self.seen.update(zip(new, word_scores(self.model, new).tolist(), strict=True))
        out = np.zeros((len(texts), 4))
        for i, words in enumerate(split):
            if words:
                s = np.fromiter(map(self.seen.__getitem__, words), float, len(words))
                size = len(texts[i])
                top = np.sort(s[np.argpartition(s, -3)[-3:]] if len(s) > 3 else s)[::-1]
                out[i] = np.clip(s.sum() / max(size, 1), -1, 1) * 20, min(top[0], 30) / 5, min(top[:2].mean(), 30) / 5 if len(top) > 1 else 0, np.log1p(len(words)) / 4
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.model.weights[:-1] + self.model.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, the bias last, under a normal prior that counts for less the more
    rows there are; the classes weigh as they occur."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: list[tuple[str, int]]) -> KneserNey:
    """The logistic function from thirds of the sample, each scored by the counts of the other two; then counts from all of
    it. Without both classes every text scores the toxic share of the sample."""
    def counts(rows):
        out = [Counter(), Counter()]
        for text, y in rows:
            out[1 - y].update(words_of(text))
        return out

    y = np.array([s[1] for s in sample], float)
    empty = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)
    if len(set(y.tolist())) < 2:
        share = y.mean() if len(y) else 0.0
        return KneserNey(*empty, np.array([0, 0, 0, 0, np.log((share + 1e-6) / (1 - share + 1e-6))]))
    x = np.zeros((len(sample), 4))
    for third in range(3):
        model = KneserNey(*fit_counts(*counts([row for i, row in enumerate(sample) if i % 3 != third])), np.zeros(5))
        x[third::3] = Scorer(model).features([text for text, _ in sample[third::3]])
    return KneserNey(*fit_counts(*counts(sample)), logistic(x, y))


def fit_on(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> KneserNey:
    """The model from a bounded sample of labelled rows whose id fulfils `learn`; see common.labelled_sample."""
    return fit([(t.decode(), y) for t, y in labelled_sample(docs, labels, label, learn, id_col, text_col, per_class, max_bytes)])


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row, from its whole text alone; null and empty texts score what no words score.
    Null ids and repeated rows are kept, other columns are not carried. No shuffle; the model's size is bounded by the
    sample's."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for part in slices(batches, "text"):
            got = scorer.scores([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got, pa.float64())], ["id", "score"])
        scorer.seen.clear()
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCORE_SCHEMA).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: KneserNey, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score stays below the threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for part in slices(batches, text_col):
            yield part.filter(pa.array(scorer.scores([x or "" for x in part.column(text_col).to_pylist()]) < threshold))
        scorer.seen.clear()
        trim()

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op4's columns: learning from rows whose crc32(doc_id) mod 4 isn't 2, on which held_out is false. A row without a
    doc_id is not held out, for it has no label either."""
    model = fit_on(docs, labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 4 != 2)
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
