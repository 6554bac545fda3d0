"""Set and edit similarities of strings.

The edit ratio allows insertions and deletions: 2 * LCS / (len a + len b), and 1
for two empty strings. LCS lengths come from a bit-parallel recurrence on
Python integers, in an Arrow UDF, with equal and disjoint values answered first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit of the row for each character of a."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / n if a and b else 0.0


@F.arrow_udf(DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.to_pylist(), b.to_pylist(), strict=True):
        value = known.get(pair)
        if value is None:
            value = known[pair] = ratio(pair[0] or "", pair[1] or "")
        out.append(value)
    return pa.array(out, pa.float64())


def edit_ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def _sorted(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def token_sort_ratio(words1: Column, words2: Column) -> Column:
    """The edit ratio of sorted words."""
    return _ratio(_sorted(words1), _sorted(words2))


def token_set_ratio(words1: Column, words2: Column) -> Column:
    """The best edit ratio among shared words, and shared words with either side's others; 1 if one side has no others."""
    both, only1, only2 = F.array_intersect(words1, words2), F.array_except(words1, words2), F.array_except(words2, words1)
    shared = _sorted(both)
    with1, with2 = F.trim(F.concat_ws(" ", shared, _sorted(only1))), F.trim(F.concat_ws(" ", shared, _sorted(only2)))
    some = F.size(both) > 0
    best = F.greatest(_ratio(with1, with2), F.when(some, _ratio(shared, with1)).otherwise(0.0), F.when(some, _ratio(shared, with2)).otherwise(0.0))
    empty = (F.size(words1) == 0) | (F.size(words2) == 0)
    return F.when(empty, 0.0).when(some & ((F.size(only1) == 0) | (F.size(only2) == 0)), 1.0).otherwise(best)


def jaccard(a: Column, b: Column) -> Column:
    """Of sets as arrays: 1 for two empty ones, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
