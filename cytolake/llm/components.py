"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._spark import written


def _both(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the least of its neighbourhood."""
    both = _both(e)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, is tied to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _contracted(e: DataFrame) -> DataFrame:
    """What is connected within a batch of rows as one star; the components stay the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()])
            name, at = np.unique(ends, return_inverse=True)
            x, y = at[: b.num_rows], at[b.num_rows :]
            root = np.arange(len(name))
            while True:
                low = np.minimum(root[x], root[y])
                was = root.copy()
                for end in (x, y):
                    np.minimum.at(root, root[end], low)
                    np.minimum.at(root, end, low)
                while (root[root] != root).any():
                    root = root[root]
                if (root == was).all():
                    break
            own = np.flatnonzero(root != np.arange(len(name)))
            yield pa.RecordBatch.from_arrays([pa.array(name[own]), pa.array(name[root[own]])], names=["a", "b"])

    return e.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex that isn't the least of its component, with the least one.

    edges: columns a, b of type long; loops and repeats are allowed.  A
    vertex without edges has no row.  Rounds go on until nothing changes; their
    number grows with the logarithm of the largest component.
    """
    links = written(edges.filter("a <> b").select("a", "b"), "links")  # so that no task holds the Python workers of two steps
    e = written(_contracted(links).distinct(), "edges")
    state = None
    while True:
        e = written(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e
        state = now
