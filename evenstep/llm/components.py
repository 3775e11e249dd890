"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstep.llm.common import written


class Forest:
    """Disjoint sets of numbers; a set's root is its least member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        if x not in up:
            return x
        path = []
        while x in up:
            path.append(x)
            x = up[x]
        for y in path:
            up[y] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up)]


def local_stars(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """Fewer edges that join the same nodes: each task's edges as stars, in rounds of `most` nodes."""

    def run(batches):
        forest = Forest()

        def out():
            stars = forest.stars()
            return pa.record_batch([pa.array([a for a, _ in stars], pa.int64()), pa.array([b for _, b in stars], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.up) > most:
                yield out()
                forest = Forest()
        if forest.up:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that it reaches.

    Each round gives every node's larger neighbours to its least neighbour, then every node's
    smaller ones, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. Least neighbours come from partial aggregates, are written, and go back by
    joins of two tables, which Spark splits where a node has very many edges.
    """
    stars = written(local_stars(edges.where("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if seen.n == 0 or seen == mark:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = written(down, "large-star")
        least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = written(small.where("a <> b").distinct(), "small-star")
