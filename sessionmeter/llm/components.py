"""Connected components by alternating large-star and small-star steps, all in joins.

Each round halves distances to the smallest node, so the number of rounds grows with the
logarithm of the longest chain. A round's edges are written to the shared folder. Hot nodes
are aggregated before the shuffle, and joins on them are ones that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from the larger node a to the smaller b."""
    least = _least_neighbour(edges)
    moved = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.withColumnRenamed("least", "b"))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) of every node with an edge.

    Edges have long columns ``a`` and ``b``; direction, repeats and loops do not matter.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    down, before = stored(down), None
    now = _mark(down)
    while now != before:
        before = now
        down = stored(_small_star(_large_star(down)).distinct())
        now = _mark(down)
    stars = down.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
