"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum, pre-aggregated before its shuffle, and an equi-join that adaptive execution can
split on a hot node; nothing but two counters a round reaches the driver. Each round ends at files in the shared
folder, so that a lost executor costs a task and not the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable_at


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a and b, one bigint each. Returns (a, b): each node but the least of its component, and that least node.

    An empty table gives an empty table; loops and repeated edges have no effect; null ends are dropped.
    """
    spark = edges.sparkSession
    now, path = durable_at(edges.select("a", "b").filter("a <> b").distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).alias("mark")
    before = tuple(now.agg(mark).first()[0])
    if not before[0]:
        return now
    for _ in range(most_rounds):
        after, after_path = durable_at(_small_star(_large_star(now)))
        drop(spark, path)
        now, path = after, after_path
        state = tuple(now.agg(mark).first()[0])
        if state == before:
            return now
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
