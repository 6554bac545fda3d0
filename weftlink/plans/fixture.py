"""Record tables in place of business records, from the documents table, in Spark and in SQL.

doc_id modulo 3 picks the source; the first 60 characters of the text are the
name, the next 100 the address, and the language is the country. True pairs
have the same whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink import schema

SQL = """
src AS (
  SELECT 'S' || CAST(doc_id % 3 + 1 AS VARCHAR) || '-' || CAST(doc_id AS VARCHAR) AS entity_id, substr(text, 1, 60) AS business_name,
         substr(text, 61, 100) AS business_address, lang AS country, 'S' || CAST(doc_id % 3 + 1 AS VARCHAR) AS source, text FROM documents),
s1 AS (SELECT * FROM src WHERE source = 'S1'),
s23 AS (SELECT * FROM src WHERE source <> 'S1'),
truth AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS target_id FROM s1 a JOIN s23 b ON a.text = b.text),
gt AS (
  SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(t.target_id, ',' ORDER BY t.target_id), '') AS matched_entity_ids
  FROM s1 LEFT JOIN truth t ON t.s1_id = s1.entity_id GROUP BY s1.entity_id)
"""


class Records:
    """s1, s23: record tables with source; truth: (s1_id, target_id); spine: (s1_id); gt: ids joined."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        source = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
        self.raw = docs.select(
            F.concat(source, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.substring("text", 1, 60).alias("business_name"),
            F.substring("text", 61, 100).alias("business_address"), F.col("lang").alias("country"), source.alias("source"), "text",
        )
        self.sources: DataFrame = schema.normalise_sources(self.raw.drop("text"))
        self.s1, self.s23 = self.sources.where("source = 'S1'"), self.sources.where("source <> 'S1'")
        left = self.raw.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), F.xxhash64("text").alias("h"), "text")
        right = self.raw.where("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.xxhash64("text").alias("h"), "text")
        self.truth = left.join(right, ["h", "text"]).select("s1_id", "target_id").distinct()
        self.spine = self.s1.select(F.col("entity_id").alias("s1_id"))
        joined = self.truth.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("m"))
        self.gt = self.spine.join(joined, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"))
