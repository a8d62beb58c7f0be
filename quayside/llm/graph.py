"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

EDGES = "a bigint, b bigint"


class Forest:
    """Union-find over whatever ids one task meets."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        """Unite under the smaller root; False if they were one already."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def edge_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars around its local components' smallest ids."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
    nodes = list(forest.parent)
    yield edge_batch(nodes, [forest.find(x) for x in nodes])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b bigint); the component is its smallest node.

    Every round's edges are written to shared scratch; rounds end when the
    edges no longer change, after a number that grows with the logarithm of
    the nodes. Only counts reach the driver. A star's centre may have any
    number of edges: minima are pre-aggregated, and the join back is one that
    adaptive execution splits.
    """
    e = stored(edges.where("a <> b").mapInArrow(_local_stars, EDGES), "edges")
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # all edges now point from the larger to the smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = stored(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == seen:
            break
        seen = now
    stars = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
