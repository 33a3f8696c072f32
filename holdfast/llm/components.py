"""Connected components of a distributed edge list by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, itself included."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    up = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return up.union(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of longs: rows (a, b) with b the least node of a's component, for every a that isn't it.

    Each round keeps at most as many edges as it got and is cut from its lineage; rounds grow with the logarithm of the
    longest path. No component meets in one task: least neighbours are aggregated before they are shuffled, and the
    joins' hot keys can be split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)))
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now
