"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import Steps

EDGES_AT_ONCE = 2_000_000  # so many edges, of 16 bytes each, are joined up in one task


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node each is connected with.

    All trees hook on their smallest neighbour at once and are flattened again, so each round at
    least halves the trees that have neighbours left.
    """
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[:len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[one], root[two]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if parts:
        nodes, roots = roots_of(*map(np.concatenate, zip(*parts, strict=True)))
        for low in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low:low + 10_000]), pa.array(roots[low:low + 10_000])],
                                             names=["node", "root"])


def _contracted(edges: DataFrame, steps: Steps, larger: bool) -> DataFrame:
    """Hangs the larger (or the other) neighbours of every node on its smallest one."""
    both = edges.select("a", "b")
    if larger:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = steps.keep(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    hung = both.join(least, "a").filter("b > a" if larger else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        hung = hung.union(least.select("a", F.col("m").alias("b")))
    return hung.filter("a > b").distinct()


def connected(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs: root is the smallest node it is connected with.

    A graph of up to EDGES_AT_ONCE edges takes one pass of one task.  A larger one is contracted by
    rounds of stars, all joins and aggregations by node; the contraction ends when a round changes nothing.
    """
    edges = steps.keep(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] <= EDGES_AT_ONCE:
            return steps.keep(edges.coalesce(1).mapInArrow(_joined_up, "node long, root long"))
        if now == state:
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return found.union(found.select(F.col("root").alias("node"), "root").distinct())
        state = now
        edges = steps.keep(_contracted(_contracted(edges, steps, True), steps, False))
