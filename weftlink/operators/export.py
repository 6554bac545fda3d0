"""Result tables: folding pairs into rows, checks, and merging of several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import text


def _folded(pairs: DataFrame, spine: DataFrame, name: str) -> DataFrame:
    """A row for each entity of the spine; ids joined in order, empty without any."""
    ids = pairs.groupBy("s1_id").agg(text.fold_ids(F.col("target_id")).alias(name))
    return spine.select("s1_id").distinct().join(ids, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def format_output(matches: DataFrame, found: DataFrame, spine: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids, candidate_entity_ids); matches are candidates too."""
    both = matches.select("s1_id", "target_id").union(found.select("s1_id", "target_id"))
    return _folded(matches, spine, "matched_entity_ids").join(_folded(both, spine, "candidate_entity_ids"), "source1_entity_id")


def validate(output: DataFrame, spine: DataFrame) -> DataFrame:
    """(check, failures): entities that lack a row, rows that are no entity's or repeat one, and matches that are no candidates."""
    rows = output.select(F.col("source1_entity_id").alias("s1_id"))
    entities = spine.select("s1_id").distinct()
    ids = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    stray = output.where(F.size(F.array_except(ids("matched_entity_ids"), ids("candidate_entity_ids"))) > 0)
    checks = {
        "missing_entities": entities.join(rows, "s1_id", "left_anti"),
        "unknown_entities": rows.join(entities, "s1_id", "left_anti"),
        "repeated_entities": rows.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1"),
        "matches_without_candidate": stray,
    }
    out = None
    for name, df in checks.items():
        row = df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


def merge_outputs(runs: list[DataFrame], spine: DataFrame) -> DataFrame:
    """One output from several; of an entity in more than one run the last run's row holds. Matches join the candidates id by id."""
    every = None
    for i, df in enumerate(runs):
        row = df.select("source1_entity_id", "matched_entity_ids", "candidate_entity_ids", F.lit(i).alias("run"))
        every = row if every is None else every.unionByName(row)
    order = Window.partitionBy("source1_entity_id").orderBy(F.desc("run"))
    last = every.withColumn("at", F.row_number().over(order)).where("at = 1")
    ids = F.array_union(text.split_ids(F.col("candidate_entity_ids")), text.split_ids(F.col("matched_entity_ids")))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    merged = last.select(F.col("source1_entity_id").alias("s1_id"), joined(text.split_ids(F.col("matched_entity_ids"))).alias("m"), joined(ids).alias("c"))
    return spine.select("s1_id").distinct().join(merged, "s1_id", "left").select(
        F.col("s1_id").alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"), F.coalesce("c", F.lit("")).alias("candidate_entity_ids")
    )
