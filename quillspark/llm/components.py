"""Connected components of link tables, without gathering links on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.durable import durable

#: Links that one task contracts at once (about 200 bytes each).
TASK_LINKS = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's links as stars: each node beside the least node that they reach."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                low, high = (ra, rb) if ra < rb else (rb, ra)
                parent[high] = low
                parent.setdefault(low, low)
    children = [x for x in parent if root(x) != x]
    for lo in range(0, len(children), 100_000):
        some = children[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["child", "root"])


def _contracted(links: DataFrame) -> DataFrame:
    held = durable(links, "links")
    parts = max(1, -(-held.count() // TASK_LINKS))
    return durable(held.coalesce(parts).mapInArrow(_contract, "child long, root long"), "stars")


def _settled(stars: DataFrame) -> bool:
    """Every child has one root, and no root is a child."""
    twice = stars.groupBy("child").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("child")
    chained = stars.select(F.col("root").alias("child")).distinct().join(stars.select("child"), "child", "left_semi")
    return twice.unionByName(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(child, root): each linked node but a component's least, beside that least node.

    ``links`` has two bigint columns. Each round hangs every node below the least neighbour
    it has and below that one's own, then contracts the links that meet in one task, so chains
    shorten by more than half. A node in many links is pre-aggregated to one row before a join.
    Self-links and repeated links are allowed; an empty table has no components.
    """
    a, b = links.columns
    stars = _contracted(links.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("root")).filter("child <> root").distinct())
    while not _settled(stars):
        least = stars.groupBy("child").agg(F.min("root").alias("least"))
        hung = stars.join(least, "child").select("child", "root", "least")
        flat = hung.select("child", F.col("least").alias("root")).unionByName(hung.filter("root > least").select(F.col("root").alias("child"), F.col("least").alias("root"))).distinct()
        above = flat.groupBy("child").agg(F.min("root").alias("above")).withColumnRenamed("child", "root")
        stars = _contracted(flat.join(above, "root", "left").select("child", F.coalesce("above", "root").alias("root")).distinct())
    return stars
