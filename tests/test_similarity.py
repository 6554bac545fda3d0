from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlink.functions import similarity

texts = st.text(alphabet="ab c😀é", max_size=12)


def plain(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(texts, texts)
def test_lcs(a, b):
    assert similarity.lcs_length(a, b) == plain(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a)


def test_columns(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"]), (["x", "y"], ["y", "x"]), (["x"], ["x", "z"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select(similarity.jaccard(a, b).alias("j"), similarity.token_set_ratio(a, b).alias("s"), similarity.token_sort_ratio(a, b).alias("t")).collect()
    assert [round(x.j, 6) for x in got] == [1.0, 0.0, 0.333333, 1.0, 0.5]
    assert [got[i].s for i in (0, 1, 3, 4)] == [0.0, 0.0, 1.0, 1.0]
    assert got[3].t == 1.0
