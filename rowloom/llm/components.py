"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds before giving up; a round at least halves the paths, so this is far beyond any input.
MOST_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = near.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    return out.where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    out = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return out.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) with a < b, long -> node, component: the least node that can be reached. Nodes without an edge are left out.

    Each round is written to the shared folder, so lineage stays short. Sizes and sums of two
    rounds that agree mean that nothing moved.
    """
    now, before = materialize(edges.select("a", "b").where("a < b").distinct(), "cc"), None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        now = materialize(_small_star(_large_star(now)), "cc")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
