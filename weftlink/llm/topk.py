"""Exact top-k by inner product: a three-phase uniform threshold over slices of the components.

The score of a candidate is the sum of its partial scores over ``SLICES`` slices.

1. Each task gathers, for each query, the candidates with the best partial
   scores in each slice and their totals. The k-th best of those totals over all
   tasks is a safe cutoff: the k-th best of all candidates is no lower.
2. The cutoff of each query goes to all tasks. A total of at least the cutoff
   needs a partial score of at least cutoff / SLICES, the same in each slice;
   tasks collect the candidates that reach it somewhere.
3. Those are resolved by their exact totals, and what reaches the cutoff goes on
   to the last selection of k.

Scale. Queries are a stated set; they are broadcast in parts of bounded size
(``vectors.PART``) and each part meets all candidates, block by block, where
they lie. Phase 1 sends k rows for each query and task, phase 3 little more than
k in all unless many candidates tie at the cutoff, all of which are kept.

Edge cases. Vectors that are null or empty or have null or non-finite components
take no part, nor do vectors of another length than the query's. With fewer than
k candidates all are returned. Rows of one id are candidates each, but none for
a query of that id; of several query rows of one id the smallest vector asks.
Equal scores go to the smaller id. Components that could take a product beyond
2**62 are multiplied as Python integers; a score outside 64 bits counts as the
nearest 64-bit integer, and a component beyond 2**900 as 2**900. An empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import vectors

K, SLICES = 10, 2
#: Candidates gathered from each slice in phase 1, in multiples of k.
DEPTH = 4
SCALE = 1024.0

_FOUND = "query_id long, vec_id long, score long"


def quantised(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold these integers exactly."""
    return np.floor(np.clip(rows, -(2.0**890), 2.0**890) * SCALE)


def _wide(rows: np.ndarray) -> np.ndarray:
    """Which rows have components so large that a product of two such rows may not fit."""
    return np.abs(rows).max(1, initial=0) > (2**62 / max(1, rows.shape[1])) ** 0.5


def _by_range(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places of queries and of rows that meet, in parts of at most 256 queries, and whether their products need Python integers."""
    q, r = _wide(queries), _wide(rows)
    for some, wide_query in ((np.flatnonzero(~q), False), (np.flatnonzero(q), True)):
        for a in range(0, len(some), 256):
            for at, wide_row in ((np.flatnonzero(~r), False), (np.flatnonzero(r), True)):
                if len(at):
                    yield some[a : a + 256], at, wide_query or wide_row


def _long_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in Python integers, to the nearest 64-bit integer."""
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in exact], np.int64).reshape(exact.shape)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a with those of b."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _slices(width: int) -> list[slice]:
    n = min(SLICES, width)
    edges = [width * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _batch(queries: list, ids: list, scores: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (queries, ids, scores)], ["query_id", "vec_id", "score"])


def _local_lists(batches: Iterator[pa.RecordBatch], part: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: the k best totals among the candidates at the head of some slice's list, of each block."""
    query_ids, queries = part.value
    for ids, rows in vectors.by_length(batches):
        if rows.shape[1] != queries.shape[1]:
            continue
        rows, out = quantised(rows), ([], [], [])
        for asked, of, wide in _by_range(queries, ids, rows):
            some, part_ids, part_rows = queries[asked], ids[of], rows[of]
            depth = min(len(of), DEPTH * k + 1)
            if wide:
                total = _long_dots(some, part_rows)
                heads = [np.broadcast_to(np.arange(len(of)), total.shape)]
            else:
                partial = [_dots(some[:, s], part_rows[:, s]) for s in _slices(rows.shape[1])]
                heads = [np.argpartition(x, len(of) - depth, axis=1)[:, len(of) - depth :] for x in partial]
                total = sum(partial)
            for i, q in enumerate(query_ids[asked]):
                at = np.unique(np.concatenate([h[i] for h in heads]))
                at = at[part_ids[at] != q]
                at = at[vectors.best(total[i, at], part_ids[at], k)]
                for x, y in zip(out, (np.full(len(at), q), part_ids[at], total[i, at]), strict=True):
                    x.append(y)
        yield _batch(*out)


def _sufficient(batches: Iterator[pa.RecordBatch], part: Broadcast, cutoffs: Broadcast) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: candidates that reach their share of the cutoff in some slice, resolved exactly."""
    query_ids, queries = part.value
    for ids, rows in vectors.by_length(batches):
        if rows.shape[1] != queries.shape[1]:
            continue
        rows, out = quantised(rows), ([], [], [])
        parts = _slices(rows.shape[1])
        for asked, of, wide in _by_range(queries, ids, rows):
            some, own, cut, part_ids, part_rows = queries[asked], query_ids[asked], cutoffs.value[asked, None], ids[of], rows[of]
            if wide:
                total = _long_dots(some, part_rows)
                i, j = np.nonzero((total >= cut) & (part_ids != own[:, None]))
                for o, y in zip(out, (own[i], part_ids[j], total[i, j]), strict=True):
                    o.append(y)
                continue
            enough = np.zeros((len(some), len(of)), bool)
            share = cut // len(parts)  # a total of cut or more needs a part of at least its share
            for s in parts:
                enough |= _dots(some[:, s], part_rows[:, s]) >= share
            q, c = np.nonzero(enough)
            for x in range(0, len(q), 1 << 18):
                i, j = q[x : x + (1 << 18)], c[x : x + (1 << 18)]
                exact = np.einsum("nd,nd->n", some[i].astype(np.int64), part_rows[j].astype(np.int64))
                keep = (exact >= cut[i, 0]) & (part_ids[j] != own[i])
                for o, y in zip(out, (own[i[keep]], part_ids[j[keep]], exact[keep]), strict=True):
                    o.append(y)
        yield _batch(*out)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products of floor(SCALE * x) with candidates of other ids."""
    take = lambda df: df.where(F.col(id_col).isNotNull() & vectors.valid(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked, rows = take(queries), take(candidates)
    sc = rows.sparkSession.sparkContext
    out = rows.sparkSession.createDataFrame([], _FOUND)
    for ids, vectors_ in vectors.query_parts(asked):
        ids, first = np.unique(ids, return_index=True)
        part = sc.broadcast((ids, quantised(vectors_[first])))
        lists = rows.mapInArrow(lambda it, p=part: _local_lists(it, p, k), _FOUND)
        # the k-th best; with fewer there is no cutoff
        kth = vectors.ranked(lists, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        cut = np.full(len(ids), -(2**63), np.int64)
        cut[np.searchsorted(ids, kth.column("query_id").to_numpy())] = kth.column("score").to_numpy()
        cutoffs = sc.broadcast(cut)
        out = out.union(rows.mapInArrow(lambda it, p=part, c=cutoffs: _sufficient(it, p, c), _FOUND))
    return vectors.ranked(out, k)
