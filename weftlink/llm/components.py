"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and joins on the edge table, so a component of
any size stays spread over tasks; the table shrinks to stars in a number of
rounds that grows with the logarithm of the longest path. Only a count and a
checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import _spark


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", "m")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids -> (id, component): for each id that isn't itself the smallest of its component, that smallest id.

    Loops and repeated or reversed links make no difference; no links give an empty table.
    """
    now = _spark.written(edges.select("a", "b").where("a != b"), "links")
    seen = None
    for _ in range(rounds):
        now = _spark.written(_small_star(_large_star(now)), "stars")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
