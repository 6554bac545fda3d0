"""Scores of matches against the truth: per entity, and macro means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink import schema


def counts(predicted: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """(s1_id, np, nt, tp) for each entity of the spine; entities without rows elsewhere have zeros."""
    pairs = predicted.select("s1_id", "target_id", F.lit(1).alias("p"), F.lit(0).alias("t")).union(truth.select("s1_id", "target_id", F.lit(0), F.lit(1)))
    each = pairs.groupBy("s1_id", "target_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    per = each.groupBy("s1_id").agg(F.sum("p").alias("np"), F.sum("t").alias("nt"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    return spine.select("s1_id").distinct().join(per, "s1_id", "left").na.fill(0)


def with_scores(per: DataFrame, beta: float = schema.BETA) -> DataFrame:
    """Adds precision, recall and f. An entity without matches is right only if nothing is predicted; one with matches and no hit has 0."""
    p, r = F.col("tp") / F.col("np"), F.col("tp") / F.col("nt")
    b = beta * beta
    case = lambda value: F.when(F.col("nt") == 0, F.when(F.col("np") == 0, 1.0).otherwise(0.0)).when(F.col("tp") == 0, 0.0).otherwise(value)
    return per.select("*", case(p).alias("precision"), case(r).alias("recall"), case((1 + b) * p * r / (b * p + r)).alias("f"))


def macro(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over entities, and over those without and with matches; an empty table has zeros."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    single = F.col("nt") == 0
    return scored.groupBy(*(by or [])).agg(
        mean(F.col("f")).alias("macro_f"), mean(F.col("precision")).alias("macro_precision"), mean(F.col("recall")).alias("macro_recall"),
        mean(F.when(single, F.col("f"))).alias("singleton_f"), mean(F.when(~single, F.col("f"))).alias("matched_f"),
        F.count("*").alias("entities"), F.count_if(single).alias("singletons"), F.count_if(~single).alias("matched"),
    )


def evaluate(predicted: DataFrame, truth: DataFrame, spine: DataFrame, beta: float = schema.BETA) -> DataFrame:
    """One row of macro scores over the entities of the spine."""
    return macro(with_scores(counts(predicted, truth, spine), beta))
