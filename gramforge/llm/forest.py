"""Quality rules judged by an isolation forest.

Rule statistics of each whole text become shares (symbols, capitals, repeated lines and words, ...). Random splits
isolate a text with unusual shares early, so a short mean path over the trees means an anomaly. The forest is grown on all
documents labelled good: grown on unlabelled ones too, for which junk is common and no anomaly, it keeps many times as much junk.
From which path length on a document is kept is calibrated on all labelled documents.

Splits are drawn within the box of all labelled rows and don't depend on single rows, so each tree is drawn first; then the
rows in each of its nodes are counted, in one pass over all of them. Only the box, these counts and a histogram of paths
reach the driver: their size depends on TREES, DEPTH and STEPS, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.common import slices, written

#: The forest's usual size.
TREES, DEPTH, SEED = 128, 8, 11
#: Mean paths are told apart in steps of one part in so many.
STEPS = 1024
#: Share of good labelled documents that may be lost at most when the threshold is chosen.
MAX_LOSS = 0.002
#: Windows of so many words count as repeated text.
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct"]
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_KINDS = {name: np.isin(np.arange(256), list(chars)) for name, chars in (("n_symbols", b"#*$%&|<>"), ("n_capitals", bytes(range(65, 91))), ("n_marks", bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])))}
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[np.concatenate([[0], ends])]
    return np.diff(total)


def statistics(texts: list[bytes]) -> pd.DataFrame:
    """The rule statistics of each text. Words are what lies between the six ASCII white-space characters; characters are
    code points; a repeated line has a word and equals an earlier one; a repeated word lies in a window of WINDOW words
    that occurs twice or more in the text."""
    n = len(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    out = pd.DataFrame(0, index=range(n), columns=STATS, dtype=np.int64)
    out["word_chars"] = _per_text(((raw & 0xC0) != 0x80) & ~_SPACES[raw], ends)
    for name, kind in _KINDS.items():
        out[name] = _per_text(kind[raw], ends)
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    out["n_words"] = sizes
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_lines"] = [len(x) for x in lines]
    out["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
    out["n_distinct"] = [len(set(w)) for w in split]
    total = int(sizes.sum())
    if total:
        codes = pd.factorize(np.array([w for words in split for w in words], object))[0].astype(np.uint64)
        text = np.repeat(np.arange(n), sizes)
        if total >= WINDOW:
            key = _mixed(text[: total - WINDOW + 1].astype(np.uint64))
            for i in range(WINDOW):
                key = _mixed(key ^ codes[i : total - WINDOW + 1 + i])
            inside = np.flatnonzero(text[: total - WINDOW + 1] == text[WINDOW - 1 :])
            _, at, count = np.unique(key[inside], return_inverse=True, return_counts=True)
            twice = inside[count[at] >= 2]
            step = np.zeros(total + 1, np.int64)
            np.add.at(step, twice, 1)
            np.add.at(step, twice + WINDOW, -1)
            out["n_repeat_words"] = np.bincount(text, weights=np.cumsum(step[:-1]) > 0, minlength=n).astype(np.int64)
    return out


def base_failed(s: pd.DataFrame) -> np.ndarray:
    return ((s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])).to_numpy()


def shares(s: pd.DataFrame) -> np.ndarray:
    """What the forest splits on."""
    words, chars, lines = (np.maximum(s[c].to_numpy(float), 1) for c in ("n_words", "word_chars", "n_lines"))
    parts = [s["n_symbols"] / chars, s["n_capitals"] / chars, s["n_marks"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words]
    return np.column_stack([*(np.sqrt(p) for p in parts), np.minimum(s["word_chars"] / words, 40.0)])


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at leaves
    split: np.ndarray
    path: np.ndarray  # at leaves: depth and the mean rest of the path
    threshold: float = 0.0  # mean path from which a document is kept


def rest(n: np.ndarray) -> np.ndarray:
    """Mean path length in a random tree of n rows."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + 0.5772156649) - 2 * (many - 1) / many))


def drawn(box: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """Trees split down to DEPTH. Splits are drawn over the part of `box` (lowest and highest value of each share) that a
    node covers: what lies where no row does ends in an empty leaf, after few splits."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (DEPTH + 1) - 1
    feature, split = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, box[0], box[1])]
        while todo:
            k, low, high = todo.pop()
            wide = np.flatnonzero(high > low)
            if 2 * k + 2 >= nodes or not len(wide):
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            feature[t, k], split[t, k] = f, at
            less, more = high.copy(), low.copy()
            less[f] = more[f] = at
            todo += [(2 * k + 1, low, less), (2 * k + 2, more, high)]
    return Forest(feature, split, np.zeros((trees, nodes)))


def ends(forest: Forest, x: np.ndarray) -> Iterator[np.ndarray]:
    """Tree by tree, the node at which each row ends."""
    every = np.arange(len(x))
    for feature, split in zip(forest.feature, forest.split, strict=True):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (x[every, np.maximum(f, 0)] > split[at]), at)
        yield at


def counts(forest: Forest, x: np.ndarray) -> np.ndarray:
    """How many rows end at each node: trees x nodes."""
    nodes = forest.feature.shape[1]
    return np.array([np.bincount(at, minlength=nodes) for at in ends(forest, x)])


def grown(trees: Forest, ended: np.ndarray) -> tuple[Forest, Forest]:
    """Drawn trees, cut where at most one row is left, with the path lengths that follow from the rows that ended at each
    node; and the same as each of these rows sees it when it is left out itself."""
    held = ended.astype(np.int64)
    for k in range(held.shape[1] // 2 - 1, -1, -1):
        held[:, k] += held[:, 2 * k + 1] + held[:, 2 * k + 2]
    depth = np.log2(np.arange(1, held.shape[1] + 1)).astype(int)
    # a row lies in each node that it passes: there the others are one fewer, elsewhere it doesn't look
    return tuple(Forest(np.where(n > 1, trees.feature, -1), trees.split, depth + rest(n)) for n in (held, held - 1))


def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """The forest over all rows of x."""
    shape = drawn(box, trees, seed)
    return grown(shape, counts(shape, x))[0]


def mean_path(forest: Forest, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for path, at in zip(forest.path, ends(forest, x), strict=True):
        total += path[at]
    return total / max(1, len(forest.path))


def threshold(step: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The mean path that parts good from bad best (Youden's index), losing at most MAX_LOSS of the good ones, from the
    numbers of both in each step, ascending; without both classes nothing is rejected."""
    if not good.sum() or not bad.sum():
        return 0.0
    lost, caught = ((np.cumsum(n) - n) / n.sum() for n in (good, bad))
    gain = np.where(lost <= MAX_LOSS, caught - lost, -1.0)
    return float(step[gain.argmax()]) / STEPS


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id and the statistics of its whole text. A null text counts as empty; null ids and
    repeated rows are kept; other columns are not carried. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            s = statistics([x or b"" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(s[c].to_numpy(), pa.int64()) for c in STATS)], ["id", *STATS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in STATS))


def labelled(measured: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """The statistics of every measured row that has a label, with it as y. Labels of an id that are null or contradict each
    other are left out."""
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    return measured.join(y, "id").select(*STATS, "y")


def _summed(rows: DataFrame, key: str, names: list[str], run) -> pd.DataFrame:
    """What `run` makes of frames of rows, added up by key, ascending: each task sends its sums, one row for each key."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = pd.DataFrame(columns=[key, *names], dtype=np.int64)
        for part in map(run, frames):
            total = pd.concat([total, part]).groupby(key, as_index=False)[names].sum()
        yield total

    sums = rows.mapInPandas(task, ", ".join(f"{c} long" for c in [key, *names]))
    return sums.groupBy(key).agg(*(F.sum(c).alias(c) for c in names)).orderBy(key).toPandas().astype(np.int64)


def fit(rows: DataFrame) -> Forest:
    """From all rows of labelled(), which are read three times: those that are good and pass the base rules grow the trees,
    within the box of all of them; all that pass calibrate, each good one by the forest without it. No rows make a forest
    that keeps everything."""
    spark = rows.sparkSession

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in frames:
            x = shares(s)
            if len(x):
                yield pd.DataFrame({"share": range(x.shape[1]), "low": x.min(0), "high": x.max(0)})

    box = rows.mapInPandas(ranges, "share int, low double, high double").groupBy("share").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    box = box.orderBy("share").toPandas()
    if not len(box):
        return Forest(np.full((1, 1), -1, np.int8), np.zeros((1, 1)), np.zeros((1, 1)))
    shape = drawn(box[["low", "high"]].to_numpy().T)
    shipped = spark.sparkContext.broadcast(shape)

    def cells(s: pd.DataFrame) -> pd.DataFrame:
        n = counts(shipped.value, shares(s[~base_failed(s) & (s["y"] == 1)])).ravel()
        return pd.DataFrame({"cell": np.flatnonzero(n), "n": n[n > 0]})

    found = _summed(rows, "cell", ["n"], cells)
    ended = np.zeros(shape.feature.size, np.int64)
    ended[found["cell"]] = found["n"]
    forest, without = grown(shape, ended.reshape(shape.feature.shape))
    both = spark.sparkContext.broadcast((forest, without))

    def paths(s: pd.DataFrame) -> pd.DataFrame:
        s = s[~base_failed(s)]
        good, x = s["y"].to_numpy() == 1, shares(s)
        step = np.floor(STEPS * np.where(good, mean_path(both.value[1], x), mean_path(both.value[0], x)))
        return pd.DataFrame({"step": step.astype(np.int64), "good": good.astype(np.int64), "bad": 1 - good})

    found = _summed(rows, "step", ["good", "bad"], paths)
    forest.threshold = threshold(*(found[c].to_numpy() for c in ("step", "good", "bad")))
    return forest


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """The forest from every row of docs that has a label."""
    return fit(written(labelled(measure(docs, id_col, text_col), labels, label, id_col), "forest-labelled"))


def judge_measured(measured: DataFrame, forest: Forest) -> DataFrame:
    """The rows of measure() with base_failed, kept (false if base_failed, else whether the mean path reaches the threshold)
    and mean_path. No shuffle."""
    shipped = measured.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            s = part.select(STATS).to_pandas()
            paths, failed = mean_path(shipped.value, shares(s)), base_failed(s)
            arrays = [*part.columns, pa.array(failed), pa.array(~failed & (paths >= shipped.value.threshold)), pa.array(paths)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *STATS, "base_failed", "kept", "mean_path"])

    schema = "id long, " + "".join(f"{c} long, " for c in STATS) + "base_failed boolean, kept boolean, mean_path double"
    return measured.select("id", *STATS).mapInArrow(run, schema)


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, the statistics, base_failed, kept and mean_path; see measure and judge_measured. A
    null text fails the base rules, as an empty one does."""
    return judge_measured(measure(docs, id_col, text_col), forest).withColumnRenamed("id", id_col)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op6's columns. Texts are read once: the statistics are written, fitted on and judged."""
    measured = written(measure(docs), "forest-measured")
    forest = fit(written(labelled(measured, labels), "forest-labelled"))
    return judge_measured(measured, forest).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
