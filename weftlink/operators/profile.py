"""Profiling aggregates of record tables and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.schema import missing


def file_stats(**tables: DataFrame) -> DataFrame:
    """(source, total_rows, missing_names, missing_addresses, missing_countries); tables without the columns have zeros."""
    out = None
    for name, df in tables.items():
        gone = lambda c, df=df: F.count_if(missing(F.col(c))) if c in df.columns else F.lit(0).cast("long")
        row = df.agg(F.count("*").alias("total_rows"), gone("business_name").alias("missing_names"), gone("business_address").alias("missing_addresses"), gone("country").alias("missing_countries"))
        row = row.select(F.lit(name).alias("source"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def country_breakdown(records: DataFrame, by: str = "source") -> DataFrame:
    """(by, country, row_count, pct of its source)."""
    counted = records.groupBy(by, "country").agg(F.count("*").alias("row_count"))
    return counted.withColumn("pct", F.round(100.0 * F.col("row_count") / F.sum("row_count").over(Window.partitionBy(by)), 2))


def match_count(joined: Column) -> Column:
    """Commas and one more, without trimming or removing doubles; 0 for a missing value."""
    none = F.trim(F.coalesce(joined, F.lit(""))).isin("") | (joined == "nan")
    return F.when(F.coalesce(none, F.lit(True)), 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(","), F.lit(""))) + 1)


def gt_cardinality(gt: DataFrame) -> DataFrame:
    """(num_matches, n, pct)."""
    counted = gt.select(match_count(F.col("matched_entity_ids")).alias("num_matches")).groupBy("num_matches").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def gt_summary(gt: DataFrame) -> DataFrame:
    n = F.col("n")
    return gt.select(match_count(F.col("matched_entity_ids")).alias("n")).agg(
        F.count("*").alias("total_s1"), F.count_if(n == 0).alias("singleton_count"), F.round(100.0 * F.count_if(n == 0) / F.count("*"), 2).alias("singleton_pct"),
        F.round(F.avg(n), 6).alias("avg_matches"), F.median(n).alias("median_matches"), F.max(n).cast("long").alias("max_matches"), F.min(n).cast("long").alias("min_matches"), F.sum(n).cast("long").alias("total_links"),
    )


def text_profile(records: DataFrame, by: str = "source") -> DataFrame:
    """Lengths and numbers of words (blanks and one more) of names and addresses, over all rows."""
    blanks = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) + 1
    out = []
    for c, short in (("business_name", "name"), ("business_address", "addr")):
        out += [F.round(F.avg(F.length(c)), 2).alias(f"avg_{short}_len"), F.max(F.length(c)).cast("long").alias(f"max_{short}_len"), F.round(F.avg(blanks(c)), 2).alias(f"avg_{short}_words")]
    return records.groupBy(by).agg(*out)


def filter_count(records: DataFrame, country: str, by: str = "source") -> DataFrame:
    return records.where(F.col("country") == country).groupBy(by).agg(F.count("*").alias("n"))


def match_summary(matches: DataFrame, spine: DataFrame) -> DataFrame:
    """One row: entities, matched, with several matches, singletons, and links."""
    per = spine.select("s1_id").distinct().join(matches.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").na.fill(0)
    n = F.col("n")
    return per.agg(F.count("*").alias("entities"), F.count_if(n > 0).alias("matched"), F.count_if(n > 1).alias("multi_matched"), F.count_if(n == 0).alias("singletons"), F.sum(n).cast("long").alias("links"))
