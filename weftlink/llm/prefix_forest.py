"""Approximate nearest neighbours by largest inner product with a forest of hash prefixes.

Each tree gives a vector a string of ``BITS`` bits, the signs of its products
with random directions; the strings of a block, sorted, are the tree. A query
descends each tree to the entries with the longest common prefix, then all trees
ascend together, one bit at a time, until the entries that share so long a
prefix in some tree are ``ENOUGH`` of the block. Those candidates are scored by
their exact inner products and the best of all blocks are kept.

An inner product asks for long candidates too, so for vectors of unequal length
one more component is added to candidates that makes all equally long (0 for
queries); the largest norm is found first.

Scale. Every row is indexed, in blocks of ``vectors.BLOCK`` where it lies, so
memory is bounded and nothing is shuffled but each block's best. Queries are a
stated set, broadcast in parts of bounded size. The directions come from a seed.

Edge cases. Vectors that are null, empty or zero, or have null or non-finite
components, take no part. With fewer than k candidates all are returned. Rows of
one id are candidates each, but none for a query of that id; of several query
rows of one id the smallest vector asks. Ties go to the smaller id. An empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import vectors

K, TREES, BITS = 20, 64, 32
#: Share of a block's vectors that candidates make up at least, whatever its size.
ENOUGH = 0.45
SEED = 20

_U = np.uint64
_FOUND = "query_id long, vec_id long, score double"


def _directions(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((width, TREES * BITS))


def _strings(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A hash string for each row and tree, the first bit highest."""
    weight = _U(1) << np.arange(BITS - 1, -1, -1, dtype=_U)
    out = np.empty((len(rows), TREES), _U)
    for a in range(0, len(rows), 2048):
        signs = (rows[a : a + 2048] @ directions > 0).reshape(-1, TREES, BITS)
        out[a : a + 2048] = (signs * weight).sum(2, dtype=_U)
    return out


class PrefixForest:
    """Sorted arrays of the hash strings of some rows, one for each tree."""

    def __init__(self, rows: np.ndarray, most: float) -> None:
        """most: the largest length of any candidate anywhere."""
        self.n = len(rows)
        extra = np.sqrt(np.maximum(most**2 - (rows**2).sum(1), 0))
        self.directions = _directions(rows.shape[1] + 1)
        strings = _strings(np.column_stack([rows, extra]), self.directions)
        self.order = np.argsort(strings, axis=0).T.copy()
        self.sorted = np.take_along_axis(strings.T, self.order, axis=1)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, rows that share the longest prefixes: at least enough of them, or all."""
        strings = _strings(np.column_stack([queries, np.zeros(len(queries))]), self.directions)
        ranges = np.zeros((BITS + 1, 2, TREES, len(queries)), np.int64)
        for depth in range(BITS + 1):
            mask = _U((1 << depth) - 1) << _U(BITS - depth)
            low = strings & mask
            high = low | (_U((1 << BITS) - 1) ^ mask)
            for t in range(TREES):
                ranges[depth, 0, t] = np.searchsorted(self.sorted[t], low[:, t], "left")
                ranges[depth, 1, t] = np.searchsorted(self.sorted[t], high[:, t], "right")
            if (ranges[depth, 1] - ranges[depth, 0]).sum(0).max() < enough:
                break  # deeper prefixes hold fewer still
        for q in range(len(queries)):
            for level in range(depth, -1, -1):
                a, b = ranges[level, 0, :, q], ranges[level, 1, :, q]
                if (b - a).sum() < enough:
                    continue
                seen = np.zeros(self.n, bool)
                for t in np.flatnonzero(b > a):
                    seen[self.order[t, a[t] : b[t]]] = True
                found = np.flatnonzero(seen)
                if len(found) >= enough:
                    break
            yield found


def _search(batches: Iterator[pa.RecordBatch], part: Broadcast, most: float, k: int) -> Iterator[pa.RecordBatch]:
    query_ids, queries = part.value
    for ids, rows in vectors.by_length(batches):
        if rows.shape[1] != queries.shape[1]:
            continue
        forest = PrefixForest(rows, most)
        enough = min(len(ids), max(int(np.ceil(ENOUGH * len(ids))), k + 1))
        out = []
        for a in range(0, len(queries), 512):
            for i, at in enumerate(forest.candidates(queries[a : a + 512], enough), a):
                at = at[ids[at] != query_ids[i]]
                near = rows[at] @ queries[i]
                if len(at) > k:  # what rounding might bring among the best is compared by the sum that is returned
                    slack = 1e-12 * np.abs(rows[at]).max() * np.abs(queries[i]).sum()
                    at = at[near >= np.partition(near, len(at) - k)[len(at) - k] - slack]
                score = (rows[at] * queries[i]).sum(1)
                top = vectors.best(score, ids[at], k)
                out.append((np.full(len(top), query_ids[i]), ids[at[top]], score[top]))
        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products found among candidates of other ids."""
    square: Column = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    take = lambda df: df.where(F.col(id_col).isNotNull() & vectors.valid(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(square > 0)
    asked, rows = take(queries), take(candidates)
    spark = rows.sparkSession
    most = float(rows.agg(F.max(square)).first()[0] or 0.0) ** 0.5
    out = spark.createDataFrame([], _FOUND)
    for ids, found in vectors.query_parts(asked):
        ids, first = np.unique(ids, return_index=True)
        part = spark.sparkContext.broadcast((ids, found[first]))
        out = out.union(rows.mapInArrow(lambda it, p=part: _search(it, p, most, k), _FOUND))
    return vectors.ranked(out, k)
