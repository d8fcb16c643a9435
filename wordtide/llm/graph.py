"""Connected components of very large graphs: local union-find, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, ship, written


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges of one partition, in blocks of bounded size."""

    def out(sets: UnionFind) -> pa.RecordBatch:
        nodes = list(sets.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], names=["v", "u"])

    sets = UnionFind()
    for b in batches:
        for v, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.union(v, u)
        if len(sets.parent) > 1_000_000:
            yield out(sets)
            sets = UnionFind()
    yield out(sets)


def components(edges: DataFrame) -> DataFrame:
    """``edges``(a, b) -> (node, component): every node that has an edge, with the smallest node it reaches.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller
    ones; the number of rounds grows with the logarithm of the longest path. Smallest
    neighbours are found by partial aggregation, so a node with very many edges is no
    hot group; what joins them back is one row per node. Edges stay distributed and
    each round is written to the shared folder.
    """
    ship(edges.sparkSession)
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    e = written(e.mapInArrow(_forest, "v long, u long"), "stars")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = state
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("low"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("v"), F.least("x", "low").alias("u"))
        large = written(large.distinct(), "stars")
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").filter("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u"))
        after = written(small.unionByName(low.select("v", F.col("low").alias("u"))).distinct(), "stars")
        discard(e, large)
        e = after
