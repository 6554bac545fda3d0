"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import _spark


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, among: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, label) of at most limit labelled documents: those of the smallest hash of their id.

    The ids are chosen first, so a broadcast of at most limit of them reads the
    documents without a shuffle. Null labels and ids are left out; of repeated
    labels of one id the largest holds.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    rows = rows if among is None else rows.where(among)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max(label).cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("key"), "key").limit(limit)
    texts = docs.select(_spark.id_or_min(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return _spark.written(texts.join(F.broadcast(chosen), "key").select("key", "text", "label"), "labelled")
