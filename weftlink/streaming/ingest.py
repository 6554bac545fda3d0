"""Linking of target records that arrive in micro-batches, against a table of reference keys.

An addition of this library: each batch is blocked, scored and assigned by the
same plan as a batch job, and its winners are written in a folder of that batch,
so that a batch that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftlink import schema
from weftlink.plans import linkage


def link_batches(stream: DataFrame, s1: DataFrame, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] = linkage.word_jaccard, settings: linkage.Settings | None = None) -> StreamingQuery:
    """Starts a query that links each batch of stream (record columns) to s1 and writes (s1_id, target_id, p, batch) under out."""

    def write(batch: DataFrame, number: int) -> None:
        matches, _ = linkage.link_by(s1, schema.normalise_sources(batch), score, settings)
        matches.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
