"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order of nearness. Vectors that are close order the
pivots alike, so candidates are pairs that share at least SHARED of their NEAREST pivots. They are found through inverted
lists of pivots: two such vectors must meet in a list of the first NEAREST - SHARED + 1 of their pivots by number, so only
these lists are kept. A pair is compared in the first list in which both appear. Equal vectors are one, with the number of
ids that have it. Long lists are cut into chunks and each pair of chunks is a task's work; what leaves a task is a count for
each vector and a forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.common import written
from gramforge.llm.components import components

#: Pivots are picked from a bounded sample: the PIVOT_SAMPLE vectors that come first by xxhash64 of the id and label.
PIVOTS, NEAREST, SHARED, PIVOT_SAMPLE, APART = 256, 8, 3, 4096, 0.5
#: Rows of a list that are compared with as many others at a time.
CHUNK = 1024
#: Rows of lists that a task compares, about.
TASK_ROWS = 16384


def pick_pivots(sample: np.ndarray, most: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors in the order given, leaving out what is too close to one taken before: a dense cluster gets few."""
    out: list[np.ndarray] = []
    for v in sample:
        if not out or (np.array(out) @ v).max() < apart:
            out.append(v)
        if len(out) == most:
            break
    return np.array(out)


def nearest(pivots: np.ndarray, x: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """Each vector's nearest pivots, the nearest first; equally near ones by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int32)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The vectors that can be linked (without null or non-finite components, not zero, with a label and an id) as classes
    of equal ones: classes has _k, _l, _v, _own (the smallest id that has it), _plain (how many ids have it and no other
    vector) and _some (whether it has other ids too); members has _k, _id and _many (whether the id has several vectors)."""
    own = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col(label_col).cast("string").alias("_l"))
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = own.filter(F.col("_id").isNotNull() & F.col("_l").isNotNull() & F.col("_v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("_v", lambda c: c != 0))
    own = own.withColumn("_v", F.transform("_v", lambda c: c + F.lit(0.0)))  # -0.0 is 0.0
    named = own.select("*", F.xxhash64("_l", "_v").alias("_a"), F.xxhash64("_v", F.lit("second"), "_l").alias("_b"))
    single = named.groupBy("_a", "_b").agg(F.first("_l").alias("_l"), F.first("_v").alias("_v"), F.min("_id").alias("_own"))
    single = written(single.withColumn("_k", F.monotonically_increasing_id()), "vectors")
    ids = written(named.select("_id", "_a", "_b").distinct().join(single.select("_a", "_b", "_k"), ["_a", "_b"]).select("_id", "_k"), "vector-ids")
    many = ids.groupBy("_id").count().filter("count > 1").select("_id", F.lit(True).alias("_many"))
    members = written(ids.join(many, "_id", "left").withColumn("_many", F.coalesce("_many", F.lit(False))), "vector-members")
    sizes = members.groupBy("_k").agg(F.count_if(~F.col("_many")).alias("_plain"), F.bool_or("_many").alias("_some"))
    return written(single.join(sizes, "_k").select("_k", "_l", "_v", "_own", "_plain", "_some"), "vector-classes"), members


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_links(classes: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Rows (k, n, own, root, other): each comparison of chunks gives n, how many plain ids have the vectors that class k
    links with, and root, the smallest id that these links lead to from own. Where ids with several vectors are at one end,
    the pair of classes is there too, k and `other` (else null). Links are pairs with equal labels and dimensions whose cosine
    in double precision reaches the threshold. kind: of the components that tasks send each other."""
    sample = classes.select("_v", F.size("_v").alias("_n"), F.xxhash64("_own", "_l").alias("_h"), "_own").orderBy("_h", "_own", "_v").limit(PIVOT_SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(r._n, []).append(r._v)
    spark = classes.sparkSession
    shipped = spark.sparkContext.broadcast({n: pick_pivots(unit(rows)) for n, rows in by_size.items()})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("_v").to_pylist()
            sizes = np.array([len(x) for x in v])
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                raw = np.array([v[i] for i in own], np.float64)
                pivots = shipped.value.get(int(n))
                # a dimension that the sample missed has the one list 0
                near = np.sort(nearest(pivots, unit(raw)), axis=1) if pivots is not None else np.zeros((len(own), 1), np.int32)
                same = [batch.column(c).take(pa.array(own)) for c in ("_k", "_l", "_own", "_plain", "_some")]
                yield pa.RecordBatch.from_arrays([*same, pa.array([n] * len(own), pa.int32()), pa.array(list(near), pa.list_(pa.int32())), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())], ["_k", "_l", "_own", "_plain", "_some", "_n", "_near", "_x"])

    described = written(classes.mapInArrow(describe, "_k long, _l string, _own long, _plain long, _some boolean, _n int, _near array<int>, _x binary"), "described-vectors")
    first = F.greatest(F.lit(1), F.size("_near") - (SHARED - 1))
    listed = described.withColumn("_p", F.explode(F.slice("_near", 1, first)))
    sizes = written(listed.groupBy("_l", "_n", "_p").agg(F.count("*").alias("_g"), F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks")), "vector-lists")
    total = sizes.agg(F.sum(F.col("_g") * F.col("_chunks"))).first()[0] or 0
    tasks = max(8, -(-total // TASK_ROWS))
    sizes = sizes.drop("_g")
    listed = listed.join(sizes, ["_l", "_n", "_p"]).withColumn("_c", F.pmod(F.xxhash64("_k"), "_chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    work = listed.withColumn("_o", other).select("_l", "_n", "_p", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"), "_c", "_k", "_own", "_plain", "_some", "_near", "_x")

    def compare(chunk: np.ndarray, here: int, near: np.ndarray, x: np.ndarray, k: np.ndarray, own: np.ndarray, plain: np.ndarray, some: np.ndarray, two: bool):
        """The links between the chunks of a list (or within its one chunk): counted rows and pairs of classes."""
        a, b = (np.flatnonzero(chunk == c) for c in (chunk.min(), chunk.max())) if two else (np.arange(len(k)),) * 2
        m = np.zeros((len(near), int(near.max()) + 1), np.float32)
        m[np.arange(len(near))[:, None], near] = 1
        shared = m[a] @ m[b].T >= min(SHARED, near.shape[1])
        if here:  # the pair's first common list; lists are the first pivots of a vector, so earlier ones are all in lists
            shared &= m[a, :here] @ m[b, :here].T == 0
        x = unit(x)
        link = shared & (x[a] @ x[b].T >= threshold) & (k[a][:, None] != k[b])
        if not link.any():
            return None
        met = link.astype(np.float64)  # counts of ids are exact in it
        n = [met @ plain[b].astype(np.float64)] + ([met.T @ plain[a].astype(np.float64)] if two else [])
        la, lb = own[a].copy(), own[b].copy()
        big = np.iinfo(np.int64).max
        while True:
            new = np.minimum(la, np.where(link, lb[None, :], big).min(1))
            after = np.minimum(lb, np.where(link, new[:, None], big).min(0))
            if (new == la).all() and (after == lb).all():
                break
            la, lb = new, after
        at, to = (link & (some[a][:, None] | some[b])).nonzero()
        pairs = np.unique(np.stack([np.concatenate([k[a][at], k[b][to]]), np.concatenate([k[b][to], k[a][at]])]), axis=1)
        every = np.concatenate([a, b]) if two else a
        n, root = np.concatenate(n).astype(np.int64), np.concatenate([la, lb]) if two else la
        keep = (n > 0) | (root != own[every])
        return (k[every][keep], n[keep], own[every][keep], root[keep]), pairs

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The lists of a task, one after the other."""
        by = ["_l", "_n", "_p", "_i", "_j"]
        rows = rows.sort_values(by, ignore_index=True)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[by].iloc[1:].to_numpy() != rows[by].iloc[:-1].to_numpy()).any(1)
        starts = [*np.flatnonzero(new).tolist(), len(rows)]
        chunk, here, i, j, k, own, plain, some = (rows[c].to_numpy() for c in ("_c", "_p", "_i", "_j", "_k", "_own", "_plain", "_some"))
        near, x = rows["_near"].tolist(), rows["_x"].tolist()
        rows_, pairs_ = [], []
        for a, b in pairwise(starts):
            two = bool(i[a] != j[a])
            if b - a < 2 or two and (chunk[a:b] == chunk[a]).all():
                continue
            raw = np.frombuffer(b"".join(x[a:b]), kind).reshape(b - a, -1)
            got = compare(chunk[a:b], int(here[a]), np.stack(near[a:b]), raw, k[a:b], own[a:b], plain[a:b], some[a:b], two)
            if got:
                rows_.append(got[0])
                pairs_.append(got[1])
        if not rows_:
            return pd.DataFrame({"k": [], "n": [], "own": [], "root": [], "other": []}).astype({"k": "int64", "n": "int64", "own": "int64", "root": "int64", "other": "Int64"})
        out = pd.DataFrame(dict(zip(("k", "n", "own", "root"), map(np.concatenate, zip(*rows_, strict=True)), strict=True)))
        more = np.unique(np.concatenate(pairs_, axis=1), axis=1)
        more = pd.DataFrame({"k": more[0], "n": 0, "own": 0, "root": 0, "other": pd.array(more[1], "Int64")})
        return pd.concat([out.assign(other=pd.array([None] * len(out), "Int64")), more])

    task = F.pmod(F.xxhash64("_l", "_n", "_p", "_i", "_j"), F.lit(tasks)).alias("_task")
    return written(work.withColumn("_task", task).groupBy("_task").applyInPandas(run, "k long, n long, own long, root long, other long"), "vector-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector (id): n_links, component_id and kept. Equal vectors are compared once, however many ids have
    them. Rows with one id are one document: it links with another id, once, if any of its vectors does. Rows without an id
    give one row without links, component or keeping. Vectors that can't be linked are components of their own."""
    classes, members = usable(vectors, id_col, vector_col, label_col)
    links = near_links(classes, threshold, "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8")
    plain = classes.select("_k", "_plain")
    counts = plain.join(links.filter("other is null").groupBy("k").agg(F.sum("n").alias("_n")).withColumnRenamed("k", "_k"), "_k", "left")
    # ids with several vectors may link with an id by more than one pair of vectors: they are told apart by id
    several = members.filter("_many").select("_k", F.col("_id").alias("_y"))
    around = links.filter("other is not null").select(F.col("k").alias("_k"), "other").unionByName(several.select("_k", F.col("_k").alias("other"))).distinct()
    met = written(around.join(several.select(F.col("_k").alias("other"), "_y"), "other").select("_k", "_y").distinct(), "several-met")
    counts = counts.join(met.groupBy("_k").agg(F.count("*").alias("_m")), "_k", "left")
    counts = counts.select("_k", (F.col("_plain") + F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0)) - 1).alias("n_links"))
    one = members.filter("not _many").join(counts, "_k").select("_id", "n_links")
    ids = several.join(around, "_k").select("_y", F.col("other").alias("_k")).distinct().join(plain, "_k").groupBy("_y").agg(F.sum("_plain").alias("_p"))
    others = several.join(met.withColumnRenamed("_y", "_z"), "_k").filter("_y != _z").select("_y", "_z").distinct().groupBy("_y").agg(F.count("*").alias("_q"))
    more = ids.join(others, "_y", "left").select(F.col("_y").alias("_id"), (F.col("_p") + F.coalesce("_q", F.lit(0))).alias("n_links"))
    ends = members.join(classes.select("_k", "_own"), "_k").select(F.col("_id").alias("id"), F.col("_own").alias("root"))
    found = components(links.filter("other is null").select(F.col("own").alias("id"), "root").unionByName(ends))
    every = vectors.select(F.col(id_col).cast("long").alias("_id")).distinct()
    out = every.join(one.unionByName(more), "_id", "left").join(found.withColumnRenamed("id", "_id"), "_id", "left")
    own = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("_id") == own, F.lit(False)).alias("kept"))
