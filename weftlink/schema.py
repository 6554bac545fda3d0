"""Table schemas, constants, and the one rule for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
GROUND_TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_COLUMNS = ("source1_entity_id", "candidate_entity_ids")

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in SOURCE_COLUMNS])
GROUND_TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in GROUND_TRUTH_COLUMNS])

DELIMITER, ENCODING = "\t", "utf-8"
BETA = 0.5
CHUNK_ROWS = 100_000
MAX_BLOCK = 300
TOP_K = 35
SEED = 42


def missing(column: Column) -> Column:
    """Null, empty and the text nan all mean that a value is missing."""
    return F.coalesce(column, F.lit("")).isin("", "nan")


def normalise_sources(df: DataFrame) -> DataFrame:
    """Missing values as empty strings and ids without outer blanks, once, where rows come in."""
    values = [F.when(missing(F.col(c)), "").otherwise(F.col(c)).alias(c) for c in SOURCE_COLUMNS if c != "entity_id" and c in df.columns]
    rest = [c for c in df.columns if c not in SOURCE_COLUMNS]
    return df.select(F.trim("entity_id").alias("entity_id"), *values, *rest)
