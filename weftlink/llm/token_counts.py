"""Exact token totals for every context limit, from one histogram of encoded lengths.

Documents are encoded where they lie; only (length, number) pairs are shuffled,
after map-side sums, so a corpus of any size becomes a table with one row for
each distinct length. Suffix sums over that table are taken in two levels:
within runs of ``RUN`` lengths, then over the sums of the runs.

Edge cases. Null and empty texts have length 0 and are counted. An empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm import _spark, _worker
from weftlink.llm.tokenizer_spec import Spec, default_spec, library_encoding

RUN = 64


@_worker.task
def _lengths(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    encode = library_encoding(spec).encode_ordinary
    for batch in batches:
        yield pa.record_batch([pa.array([len(encode(x)) if x else 0 for x in (v.as_py() for v in batch.column(0))], pa.int64())], ["length"])


def token_lengths(docs: DataFrame, spec: Spec | None = None, text_col: str = "text") -> DataFrame:
    """(length) of each row's text in tokens."""
    spec = spec or default_spec()
    _spark.with_small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _lengths(it, spec), "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, docs) of a table with a length column, written so that what reads it twice encodes nothing twice."""
    return _spark.written(lengths.groupBy("length").agg(F.count("*").alias("docs")), "lengths")


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each distinct length, taken as a context limit: suffix sums, totals and the tokens left after truncation.

    Columns: length, docs, docs_from and tokens_from (documents at least so long
    and their tokens), total_docs, total_tokens, docs_to (documents at most so
    long), truncated_tokens (sum of min(length, limit)) and quantile (the share
    of documents at most so long).
    """
    run = F.floor(F.col("length") / RUN)
    rows = histogram.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), run.alias("run"))
    down = Window.orderBy(F.col("run").desc())
    runs = rows.groupBy("run").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = down.rowsBetween(Window.unboundedPreceding, -1)
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("run", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("run").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(runs, "run").select(
        "length", "docs",
        (F.sum("docs").over(inside) + F.col("d_after")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("t_after")).alias("tokens_from"),
        "total_docs", "total_tokens",
    )
    to = F.col("total_docs") - F.col("docs_from") + F.col("docs")
    cut = F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    return out.withColumns({"docs_to": to, "truncated_tokens": cut, "quantile": to / F.col("total_docs")})


def at_limits(totals: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, truncated_tokens, docs_over) for any context limits, lengths in the corpus or not."""
    asked = totals.select("*", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context"))
    longer = F.col("length") > F.col("context")
    over = F.coalesce(F.max(F.when(longer, F.col("docs_from"))), F.lit(0))
    tokens_over = F.coalesce(F.max(F.when(longer, F.col("tokens_from"))), F.lit(0))
    return asked.groupBy("context").agg((F.max("total_tokens") - tokens_over + F.col("context") * over).alias("truncated_tokens"), over.alias("docs_over"))


def quantile_lengths(totals: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of the documents does not exceed."""
    asked = totals.select("*", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return asked.where(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
