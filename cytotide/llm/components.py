"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import materialize
from cytotide.operators.joins import broadcast_fits

#: Measured bytes of edges that one task finishes.
FINISH_BYTES = 32 << 20


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame, finish_bytes: int = FINISH_BYTES) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that isn't itself the
    least of its component; root is that least node.

    Alternates two steps until the edges are few enough to be finished in one
    task (measured, at most ``finish_bytes``) or stop changing: every node's
    greater neighbours move to its least neighbour (large star), then every
    node's smaller neighbours do (small star). Edges become stars around the
    least nodes after about log(n) rounds. Only aggregates by node and joins on
    nodes are used; each round is cut with a checkpoint.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = None
    while not broadcast_fits(edges, finish_bytes):
        size = size or _signature(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least_neighbour(both).withColumn("m", F.least("a", "m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = materialize(large)
        small = _least_neighbour(large)
        moved = large.join(small, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(edges)
        if now == size:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        size = now
    return _finished(edges)


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of every node's component, nodes being 0..n-1. Every root hooks onto its least
    neighbouring root, then paths are shortened; the number of roots halves every two turns."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := root[root], root):
            root = nxt


def _finished(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots_of(numbers[:len(a)], numbers[len(a):], len(nodes))
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(work, f"node {kind}, root {kind}")


def _signature(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum, to tell when nothing has changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
