"""Connected components of links, in rounds of joins and minima; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.common import written


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of the component of each, for links between a and b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as a forest: each node to its component's smallest."""
    held: list[np.ndarray] = []
    n = 0
    def flush():
        nodes, root = forest_of(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        keep = nodes != root
        return nodes[keep], root[keep]
    for batch in batches:
        held.append(np.array([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n > 1_000_000:
            held = [np.array(flush())]
            n = held[0].shape[1]
    if held:
        a, b = flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """a > b in every edge. Large: each node's larger neighbours go to its smallest one. Small: likewise its smaller ones."""
    around = edges if small else edges.select(F.col("a").alias("a"), "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    if small:
        # node a, its neighbours b < a and a itself go to the smallest
        joined = edges.join(low, edges["a"] == low["u"])
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        # the edge's smaller end b sends its larger neighbour a to b's smallest, and a stays linked with its own smallest
        joined = edges.join(low, edges["b"] == low["u"])
        out = joined.select("a", F.col("m").alias("b"))
    return out.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two columns of longs, either way round, repeats and loops allowed, nulls dropped. Returns id and
    component_id, the smallest id reachable, for every id that is linked with another."""
    a, b = links.columns[:2]
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = written(edges.mapInArrow(_thinned, "a long, b long"), "links")
    while not _stars(edges):
        edges = written(_star(edges, small=False), "links")
        edges = written(_star(edges, small=True).mapInArrow(_thinned, "a long, b long").distinct(), "links")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself: then that one is the smallest of all."""
    ends = edges.select(F.col("a").alias("n"), "b", F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("n"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("up")))
    odd = ends.groupBy("n").agg(F.min("b").alias("x"), F.max("b").alias("y"), F.min("up").alias("u"), F.max("up").alias("v")).filter("x != y or (u = 0 and v = 1)")
    return odd.isEmpty()
