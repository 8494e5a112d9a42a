"""Connected components of links, in Spark: links are turned into stars around the smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import written

#: Links that are joined in one task at the start (about), and tasks for that at least.
MOST_NODES, LEAST_TASKS = 250_000, 4


def _locally_joined(links: DataFrame) -> DataFrame:
    """Links with the same components: of each task, every node to the smallest one that the task's links reach from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                union.join(x, y)
            if len(union.parent) > MOST_NODES:
                yield union.star()
                union = Union()
        yield union.star()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``links`` (a, b).

    A link goes from the larger to the smaller node. In each round the other smaller neighbours of a node are
    hung on the smallest, and every node on the smallest neighbour of that one, until each node has one link,
    to a node that has none. Rounds are written to the shared folder; their number grows with the logarithm
    of the longest path.
    """
    links = written(spark, links.where("a <> b").select("a", "b"), "links")
    tasks = max(LEAST_TASKS, -(-links.count() // MOST_NODES))
    stars = written(spark, _locally_joined(links.coalesce(tasks)), "links")
    while True:
        smallest = stars.groupBy("a").agg(F.min("b").alias("m"))
        hung = stars.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"), (F.col("b") != F.col("m")).alias("moved"))
        hung = hung.select("l.a", "l.b", "moved").where("a <> b")
        over = smallest.select(F.col("a").alias("b"), F.col("m").alias("next"))
        jumped = hung.join(over, "b", "left").select("a", F.coalesce("next", "b").alias("b"), (F.col("moved") | F.col("next").isNotNull()).alias("moved"))
        stars = written(spark, jumped.groupBy("a", "b").agg(F.max("moved").alias("moved")), "links")
        if not stars.where("moved").limit(1).count():
            break
        stars = stars.select("a", "b")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), "b").distinct())


class Union:
    """Components of what one task has seen, by smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

    def star(self) -> pa.RecordBatch:
        """A link from each node that is not the smallest of its component to that one."""
        pairs = [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])
