"""Vectors in blocks: taking vectors from Arrow lists, and query sets in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of query vectors broadcast at once; a larger query set is taken in several parts.
PART = 32 << 20
#: Vectors held at once by a task.
BLOCK = 16_384


def valid(vector: str) -> Column:
    """Whether a vector and all its components are there and finite, and it has a component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(F.col(vector).cast("array<double>"), bad), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one length as rows of doubles."""
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def by_length(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of at most block vectors of one length each, from (id, vector)."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(n: int) -> tuple[np.ndarray, np.ndarray]:
        parts = held.pop(n)
        return np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])

    for batch in batches:
        for a in range(0, len(batch), block):
            part = batch.slice(a, block)
            ids, column = part.column(0).to_numpy(), part.column(1)
            sizes = np.asarray(column.value_lengths())
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                held.setdefault(int(n), []).append((ids[rows], matrix(column.take(pa.array(rows)))))
                if sum(len(i) for i, _ in held[int(n)]) >= block:
                    yield out(int(n))
    for n in list(held):
        yield out(n)


def query_parts(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of the queries (vec_id, vector): by length, and in parts of about PART bytes."""
    sizes = queries.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect()
    for n, rows in sizes:
        parts = -(-rows * n * 8 // PART)
        for i in range(parts):
            part = queries.where((F.size("vector") == n) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i)).toArrow()
            if len(part):
                ids = part.column("vec_id").to_numpy()
                rows = matrix(part.column("vector").combine_chunks())
                order = np.lexsort((*rows.T[::-1], ids))  # the same whatever order rows arrive in
                yield ids[order], rows[order]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each query, ties to smaller vec_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
