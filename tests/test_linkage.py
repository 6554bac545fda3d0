from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink import schema
from weftlink.functions import text
from weftlink.operators import assign, blocking, export, metrics, models, pairs, sampling, scoring, trees, vectors
from weftlink.plans import fixture, linkage, queries
from weftlink.sources import tables

RECORDS = "entity_id string, business_name string, business_address string, country string"


def keys_of(spark, name, address, country="US"):
    df = spark.createDataFrame([("S2-1", name, address, country)], RECORDS)
    return {r.key for r in blocking.postings(df).collect()}


def test_keys(spark):
    assert keys_of(spark, "ab", "") == set()
    assert keys_of(spark, None, "12 x") == {"us:num:x_12"}
    assert keys_of(spark, "The Blue Door Ltd", "9 Elm 75001") == {"us:np:theb", "us:nw:blue", "us:nw:door", "us:pc:75001", "us:num:t_75001"}


@pytest.mark.parametrize(("cap", "kept"), [(3, True), (2, False), (0, True)])
def test_cap(spark, cap, kept):
    df = spark.createDataFrame([(f"S2-{i}", "zebra", "", "US") for i in range(3)] + [("S2-0", "zebra", "", "US")], RECORDS)
    assert (blocking.block_index(df, cap).count() > 0) == kept


def test_candidates_tie_and_k(spark):
    t = spark.createDataFrame([("S2-2", "zebra", "", "US"), ("S2-1", "zebra", "", "US"), ("S3-1", "zebra lion", "", "US")], RECORDS)
    s = spark.createDataFrame([("S1-1", "zebra lion", "", "US"), ("S1-2", "other", "", "US")], RECORDS)
    got = [tuple(x) for x in blocking.candidates(blocking.block_index(t), s, 2).orderBy(F.desc("shared"), "target_id").collect()]
    assert got == [("S1-1", "S3-1", 3), ("S1-1", "S2-1", 2)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, target_id string, p double")


def test_injective(spark):
    got = assign.injective(edges(spark, [("s1", "t", 0.9), ("s2", "t", 0.8), ("s1", "u", 0.7)]), 0.75).collect()
    assert [(x.s1_id, x.target_id) for x in got] == [("s1", "t")]


def greedy(rows, threshold):
    used, out = set(), set()
    for s, t, p in sorted(rows, key=lambda x: (-x[2], x[0])):
        if p >= threshold and t not in used:
            used.add(t)
            out.add((s, t))
    return out


def test_injective_is_greedy_and_sweep_is_each_threshold(spark):
    rng = random.Random(3)
    rows = [(f"s{a}", f"t{b}", round(rng.random(), 3) + a * 1e-6) for a in range(8) for b in range(10) if rng.random() < 0.4]
    truth = [(f"s{a}", f"t{rng.randrange(10)}") for a in range(6)]
    scored, true = edges(spark, rows), spark.createDataFrame(truth, "s1_id string, target_id string")
    spine = spark.createDataFrame([(f"s{a}",) for a in range(8)], "s1_id string")
    sweep = {round(x.threshold, 2): x.macro_f for x in assign.threshold_sweep(scored, true, spine).collect()}
    assert len(sweep) == 26
    for t in (0.4, 0.62, 0.9):
        got = assign.injective(scored, t)
        assert {(x.s1_id, x.target_id) for x in got.collect()} == greedy(rows, t)
        assert metrics.evaluate(got, true, spine).first().macro_f == pytest.approx(sweep[t])


@pytest.mark.parametrize(("true", "pred", "f"), [([], [], 1.0), ([], ["a"], 0.0), (["a"], [], 0.0), (["a", "b"], ["a"], 1.25 * 0.5 / 0.75)])
def test_fbeta(spark, true, pred, f):
    kind = "s1_id string, target_id string"
    got = metrics.with_scores(metrics.counts(spark.createDataFrame([("s", x) for x in pred], kind), spark.createDataFrame([("s", x) for x in true], kind), spark.createDataFrame([("s",)], "s1_id string"))).first()
    assert got.f == pytest.approx(f)


def test_hungarian_against_all_permutations():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 3), (3, 3), (4, 5)):
        cost = rng.normal(size=(n, m))
        best = min(sum(cost[i, c[i]] for i in range(n)) for c in itertools.permutations(range(m), n))
        assert sum(cost[i, j] for i, j in assign.hungarian(cost)) == pytest.approx(best)


def test_one_to_one(spark):
    got = assign.one_to_one(edges(spark, [("a", "x", 0.95), ("a", "y", 0.9), ("b", "x", 0.9), ("c", "z", 0.6)]), 0.7).collect()
    assert {(g.s1_id, g.target_id) for g in got} == {("a", "y"), ("b", "x")}


def test_features(spark):
    rows = [("S1-1", "Blue Door Ltd", "12 Elm St 75001", "US"), ("S2-1", "blue door", "12 elm street 75001", "US"), ("S3-1", "zzzz", None, "US")]
    p = pairs.profiles(schema.normalise_sources(spark.createDataFrame(rows, RECORDS)))
    both = pairs.paired(spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-1", "S2-9")], "s1_id string, target_id string"), p, p)
    for f in (pairs.full_features, pairs.fast_features):
        got = {r.target_id: r for r in f(both).collect()}
        assert set(got) == {"S2-1", "S3-1"}
        same = got["S2-1"]
        assert same.name_exact_match == same.name_token_set == same.addr_token_set == same.postal_code_match == same.is_source2 == 1.0
        assert same.composite_score == pytest.approx(1.0)
        assert got["S3-1"].is_addr_missing == 1.0
        assert got["S3-1"].addr_token_set == 0.0


def test_labels_and_output(spark):
    kind = "s1_id string, target_id string"
    found, true = spark.createDataFrame([("a", "x"), ("a", "y")], kind), spark.createDataFrame([("a", "x"), ("b", "z")], kind)
    assert sorted(map(tuple, pairs.labelled_pairs(found, true, True).collect())) == [("a", "x", 1), ("a", "y", 0), ("b", "z", 1)]
    assert sorted(map(tuple, pairs.labelled_pairs(found, true, False).collect())) == [("a", "x", 1), ("a", "y", 0)]
    spine = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    out = export.format_output(true, found, spine)
    assert sorted(map(tuple, out.collect())) == [("a", "x", "x,y"), ("b", "z", "z")]
    assert {x.failures for x in export.validate(out, spine).collect()} == {0}
    bad = out.where("source1_entity_id = 'a'").withColumn("matched_entity_ids", F.lit("q"))
    assert {x["check"]: x.failures for x in export.validate(bad, spine).collect()} == {"missing_entities": 1, "unknown_entities": 0, "repeated_entities": 0, "matches_without_candidate": 1}
    merged = export.merge_outputs([out, bad], spine).where("source1_entity_id = 'a'").first()
    assert tuple(merged) == ("a", "q", "q,x,y")


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S2-1", 'a "b', "", "US"), ("S2-2", "é", "x", "FR")]
    tables.write_tsv(spark.createDataFrame(rows, RECORDS), str(tmp_path / "t"))
    got = tables.read_tsv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, got.collect())) == rows
    assert tables.read_tsv(spark, str(tmp_path / "t"), nrows=1, usecols=["entity_id"]).collect()[0].entity_id == "S2-1"
    assert [len(x) for x in tables.chunks(got, 1)] == [1, 1]
    assert [x.exists for x in tables.file_metadata(spark, [str(tmp_path / "t"), str(tmp_path / "no")]).collect()] == [True, False]
    assert tables.load_model(str(tmp_path / "none")) is None


def test_ground_truth(spark):
    gt = spark.createDataFrame([("a", " x, y,x,"), ("b", ""), ("c", None), ("d", "nan")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, tables.ground_truth_edges(gt).collect())) == [("a", "x"), ("a", "y")]
    assert tables.ground_truth_spine(gt).count() == 4


def test_samples(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("entity_id"))
    assert sampling.sample(df, 17).count() == 17
    assert sampling.sample(df, None).count() == 1000
    assert [x.entity_id for x in sampling.sample(df, 2, seed=None).collect()] == ["0", "1"]
    for share, n in ((0.9, 900), (0.0, 0), (1.0, 1000), (0.3337, 333)):
        assert sampling.holdout_split(df, share).where("is_train").count() == n
    with pytest.raises(ValueError, match="unknown table"):
        sampling.load_sample({"a": df}, "b", 1)


def test_scorers(spark):
    pair = spark.createDataFrame([("a", "x", "t", "t"), ("a", "y", "t", "u")], "s1_id string, target_id string, text1 string, text2 string")
    got = scoring.rerank(pair, lambda: lambda ps: np.array([5.0 if a == b else -5.0 for a, b in ps])).orderBy("target_id").collect()
    assert got[0].p > 0.99
    assert got[1].p < 0.01
    assert [x.p for x in scoring.rerank(pair, lambda: None).collect()] == [0.5, 0.5]
    assert scoring.to_probability(np.array([[0.0, 0.0]]), "logit")[0] == 0.5
    assert len(scoring.warm_up(lambda: None)) == 2


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [3.0, 4.0, 9.0]), ("b", [0.0, 0.0, 1.0])], "id string, vector array<double>")
    got = {x.id: x.v for x in rows.select("id", vectors.truncate_normalise(F.col("vector"), 2).alias("v")).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8])
    assert got["b"] == [0.0, 0.0]
    logits = spark.createDataFrame([([{"a": 1.0, "b": -1.0}, {"a": 2.0, "c": 0.5}],)], "x array<map<string,double>>")
    pooled = logits.select(vectors.pool_logits(F.col("x")).alias("m"), vectors.top_terms(vectors.pool_logits(F.col("x")), 1).alias("t")).first()
    assert pooled.m == pytest.approx({"a": np.log1p(2), "c": np.log1p(0.5)})
    assert [x.term for x in pooled.t] == ["a"]
    enc = vectors.encode(spark.createDataFrame([("1", "xy")], "entity_id string, text string"), lambda: lambda ts: np.array([[len(t), 1.0] for t in ts])).first()
    assert enc.vector == [2.0, 1.0]


def test_candidates_move_pairs_once(spark, data):
    """The pairs of common keys are dealt by record; counting them and choosing k take no further shuffle."""
    r = fixture.Records(spark, data)
    found = blocking.candidates(blocking.block_index(r.s23, 300), r.s1, 10)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    above = plan[: plan.index("Join")]
    assert above.count("Exchange hashpartitioning") == 1


def _best_by_id(scores, k):
    """{query: [(target, score)]} from {(query, target): score}."""
    out = {}
    for (q, t), x in sorted(scores.items(), key=lambda e: (e[0][0], -e[1], e[0][1])):
        if len(out.setdefault(q, [])) < k:
            out[q].append((t, x))
    return out


def _found_by_id(df):
    out = {}
    for x in df.orderBy("query_id", "rank").collect():
        out.setdefault(x.query_id, []).append((x.target_id, x.score))
        assert x["rank"] == len(out[x.query_id])
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_sparse_topk_sums_where_targets_lie(spark, monkeypatch, whole):
    """The same as by all pairs, in many small tables, and no row for each pair of a common term goes through a shuffle."""
    monkeypatch.setattr(vectors, "CELLS", 500)
    rng = random.Random(5)
    weight = lambda: float(rng.randint(1, 3)) if whole else rng.choice([-1.5, 0.0, 0.0000005, 0.3, 2.0])
    side = lambda name, n: [(f"{name}{i}", f"w{int(rng.random() ** 3 * 30)}", weight()) for i in range(n) for _ in range(4)] + [(f"{name}{i}", "all", 1.0) for i in range(n)]
    q, t = side("q", 60), side("t", 150)
    sums = {}
    for a, x, v in q:
        for b, y, w in t:
            if x == y:
                sums[a, b] = sums.get((a, b), 0) + v * w
    frame = lambda rows: spark.createDataFrame(rows, "id string, term string, w double")
    found = vectors.sparse_topk(frame(q), frame(t), 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = _found_by_id(found)
    want = _best_by_id({p: round(x, 6) if whole else float(vectors._rounded(np.array([x]))[0]) for p, x in sums.items()}, 4)
    if whole:
        assert got == want
    else:  # sums of such products depend on their order in the last place
        assert {a: [x for _, x in r] for a, r in got.items()} == {a: pytest.approx([x for _, x in r], abs=1.1e-6) for a, r in want.items()}


def test_rounding_is_that_of_spark(spark):
    x = [0.0000005, -0.0000005, 0.1234565, 1.0000015, 2.5, 1e300, -3.00000049999, 123456.1234565, 8589934592.1234567, 0.0]
    want = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("y")).collect()]
    assert vectors._rounded(np.array(x)).tolist() == want


def test_dense_topk_with_copies_zeros_and_few_targets(spark, monkeypatch):
    """The same as by all pairs: equal vectors on both sides, zero vectors that tie with all, lengths far apart."""
    rng = np.random.default_rng(3)
    some = rng.integers(0, 5, (700, 6)).astype(float) * rng.choice([1, 1, 1, 9], (700, 1))
    some[::20] = 0
    some[5::7] = some[4]
    rows = [(f"t{i}", v.tolist()) for i, v in enumerate(some)]
    asked = [(f"q{i}", v.tolist()) for i, v in enumerate(np.concatenate([some[:40], -some[:5]]))]
    frame = lambda x: spark.createDataFrame(x, "id string, vector array<double>")
    want = _best_by_id({(a, b): float(np.dot(v, w)) for a, v in asked for b, w in rows}, 3)
    assert _found_by_id(vectors.dense_topk(frame(asked), frame(rows), 3)) == want
    monkeypatch.setattr(vectors, "PART", 600)
    assert _found_by_id(vectors.dense_topk(frame(asked[:20]), frame(rows[:2]), 3)) == _best_by_id({(a, b): float(np.dot(v, w)) for a, v in asked[:20] for b, w in rows[:2]}, 3)


def test_dense_topk_leaves_out_short_rows(monkeypatch):
    """Rows that are too short to be among the nearest are not multiplied, and results come once for each class of copies."""
    x = np.random.default_rng(4).random((20_000, 8))
    x[:10] *= 100
    taken = []
    monkeypatch.setattr(vectors, "_best", lambda q, s, p, k, f=vectors._best: taken.append(len(q)) or f(q, s, p, k))
    query, place, score = vectors._dense_block(x[:100], x, 3, np.full(100, -np.inf))
    assert sum(taken) < 5000
    assert all(set(place[query == i]) == set(np.argsort(-(x @ x[i]))[:3]) for i in range(100))
    assert len(query) == 300


@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_dense_block_tells_rows_apart_that_single_precision_does_not(scale):
    x = (1 + 1e-9 * np.random.default_rng(6).permutation(3000)[:, None] * np.ones(4)) * scale
    query, place, _ = vectors._dense_block(x[:3], x, 5, np.full(3, -np.inf))
    assert all(set(place[query == i]) == set(np.argsort(-x[:, 0])[:5]) for i in range(3))


def test_unit_vectors_and_weights_of_terms_are_exact(spark):
    x = np.array([[3.0, 4.0, 9.0], [0.0, 0.0, 1.0]])
    assert vectors.unit(lambda: lambda texts: x, 2)()(["", ""]).tolist() == [[math.floor(0.6 * 2**20) / 2**20, math.floor(0.8 * 2**20) / 2**20], [0.0, 0.0]]
    assert vectors.unit(lambda: lambda texts: np.zeros((0, 3)))()([]).shape == (0, 3)
    texts = spark.createDataFrame([("a", "zebra of zebra lions"), ("b", None), ("c", "of")], "entity_id string, text string")
    got = vectors.term_weights(texts.na.fill(""), queries._word_logits, n=1).collect()
    assert [tuple(t) for t in got] == [("a", "lions", float(math.floor(1024 * math.log(3))))]


def test_hybrid_union_has_the_three_branches(spark, data):
    """The same as by all pairs: keys, cosines of whole records' vectors, and weighted terms of names and addresses."""
    r = fixture.Records(spark, data)
    clean = r.sources.select("entity_id", "source", text.clean_name(F.col("business_name")).alias("name"), text.clean_address(F.col("business_address")).alias("address"), "country").collect()
    asked, rows = ([x for x in clean if (x.source == "S1") == own] for own in (True, False))

    def vector(x):
        written = f"Business: {x.name} | Address: {x.address} | Country: {x.country.strip(' ')}"
        if x.source == "S1":
            written = "Instruct: Retrieve matching business identity records across noisy sources\nQuery: " + written
        counts = [written.count(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
        length = math.sqrt(sum(c * c for c in counts))
        return [math.floor(c / length * 2**20) for c in counts]

    def weights(x):
        words = sorted({w for w in f"{x.name} {x.address}".split() if len(w) > 3}, key=lambda w: (-len(w), w))
        return {w: math.floor(1024 * math.log(len(w) - 2)) for w in words[:30]}

    def nearest(side, score, k):
        all_pairs = {(a.entity_id, b.entity_id): score(x, y) for a, x in zip(asked, map(side, asked)) for b, y in zip(rows, map(side, rows))}
        return {(a, b) for a, found in _best_by_id({p: s for p, s in all_pairs.items() if s is not None}, k).items() for b, _ in found}

    want = {
        "exact": {(x.s1_id, x.target_id) for x in blocking.candidates(blocking.block_index(r.s23, 300), r.s1, 10).collect()},
        "dense": nearest(vector, lambda x, y: sum(map(int.__mul__, x, y)), 6),
        "sparse": nearest(weights, lambda x, y: sum(x[w] * y[w] for w in x.keys() & y.keys()) or None, 4),
    }
    got = {(x.s1_id, x.target_id): x.branches for x in queries.QUERIES["hybrid_union"](spark, data).collect()}
    assert got == {p: ",".join(b for b in sorted(want) if p in want[b]) for p in set().union(*want.values())}
    assert {"dense", "exact", "sparse", "dense,exact,sparse"} <= set(got.values())


def test_end_to_end(spark, data):
    r = fixture.Records(spark, data)
    matches, found = linkage.link_by(r.s1, r.s23, linkage.word_jaccard, linkage.Settings(cap=50, k=10, threshold=0.4))
    out = linkage.result(matches, found, r.s1)
    assert out.count() == r.s1.count()
    assert {x.failures for x in export.validate(out, r.spine).collect()} == {0}
    assert 0 < linkage.report(matches, r.truth, r.s1).first().macro_f <= 1


def test_models_and_save(spark, tmp_path):
    from weftlink.operators import models

    rng = random.Random(1)
    values = [("a", str(i), *[rng.random() for _ in pairs.FEATURES]) for i in range(60)]
    df = spark.createDataFrame(values, ["s1_id", "target_id", *pairs.FEATURES]).withColumn("label", (F.col("name_token_set") > 0.5).cast("int"))
    fitted = models.train_all(df, {"gbt": {"maxIter": 2, "maxDepth": 2, "seed": 1}, "forest": {"numTrees": 3, "seed": 1}, "logistic": {"C": 1.0, "maxIter": 5}})
    got = models.predict(fitted, df).withColumn("p", scoring.blend({"p_gbt": 2.0, "p_forest": 1.0, "p_logistic": 1.0}))
    assert got.agg(F.min("p"), F.max("p")).first()[0] >= 0
    tables.save_model(fitted["gbt"], str(tmp_path / "m"))
    again = models.predict_one(tables.load_model(str(tmp_path / "m")), df)
    assert [round(x.p, 9) for x in again.orderBy("target_id").collect()] == [round(x.p_gbt, 9) for x in got.orderBy("target_id").collect()]


def test_streaming(spark, data, tmp_path):
    from weftlink.streaming import ingest

    r = fixture.Records(spark, data)
    r.s23.select(*schema.SOURCE_COLUMNS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema.SOURCE).parquet(str(tmp_path / "in"))
    q = ingest.link_batches(stream, r.s1, str(tmp_path / "out"), str(tmp_path / "cp"), settings=linkage.Settings(cap=50, k=10, threshold=0.4))
    assert q.awaitTermination(120)
    batch, _ = linkage.link_by(r.s1, r.s23, linkage.word_jaccard, linkage.Settings(cap=50, k=10, threshold=0.4))
    got = spark.read.parquet(str(tmp_path / "out")).select("s1_id", "target_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("s1_id", "target_id").collect()))


def test_train_validate_link_is_registered_with_the_default_models(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(linkage, "train_and_validate", lambda s1, s23, truth, is_train, settings: seen.append(settings))
    monkeypatch.setattr(linkage, "link", lambda *args: (None, None))
    monkeypatch.setattr(linkage, "result", lambda *args: None)
    queries.QUERIES["train_validate_link"](spark, data)
    assert seen[0].params == models.default_params()
    assert seen[0].weights == linkage.Settings().weights
    assert seen[0].cap == schema.MAX_BLOCK


def _labelled(spark, n, values):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        x = [rng.randrange(values) / values for _ in pairs.FEATURES]
        rows.append([str(i), float(x[0] + x[1] * x[2] + 0.3 * rng.random() > 0.9), *x])
    return spark.createDataFrame(rows, ["id", "label", *pairs.FEATURES])


@pytest.mark.parametrize(("name", "params"), [("gbt", {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "seed": 3}), ("gbt_wide", {"maxIter": 1, "maxDepth": 5, "maxBins": 64, "seed": 3})])
def test_boosting_is_that_of_spark(spark, name, params):
    """Without draws and with all splits tried, both trainers learn the same."""
    df = _labelled(spark, 600, 7)
    p = lambda m: [x[0] for x in models.predict_one(m, df).orderBy("id").select("p").collect()]
    assert p(models.train_all(df, {name: params})[name]) == pytest.approx(p(models.train_gbt(df.select("label", *pairs.FEATURES), params)), abs=1e-9)


def test_ensembles_take_no_job_for_each_level(spark):
    """All rounds of the boosted trees and the forest in a fixed number of jobs; as good as Spark's trainers; runs agree."""
    df = _labelled(spark, 1500, 1000)
    params = models.default_params()
    some = {"gbt": {**params["gbt"], "maxIter": 60}, "forest": {**params["forest"], "numTrees": 60}}
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    fitted = models.train_all(df, some)
    assert jobs() - before < 60
    assert [len(fitted[m].stages[1].trees) for m in some] == [60, 60]
    assert fitted["gbt"].stages[1].treeWeights == [1.0] + [0.05] * 59
    assert max(t.depth for m in some for t in fitted[m].stages[1].trees) == 6
    wrong = lambda fit, m: models.predict_one(fit, df).where("(p > 0.5) != (label = 1)").count()
    assert wrong(fitted["gbt"], "gbt") <= wrong(models.train_gbt(df.select("label", *pairs.FEATURES), {**some["gbt"], "maxIter": 20}), "gbt") + 15
    assert wrong(fitted["forest"], "forest") <= wrong(models.train_forest(df.select("label", *pairs.FEATURES), some["forest"]), "forest") + 30
    again = models.train_all(df.repartition(3), some)
    p = lambda f: models.predict(f, df).orderBy("id").select("p_gbt", "p_forest").collect()
    assert p(again) == p(fitted)


@pytest.mark.parametrize(("strategy", "forest", "n"), [("0.8", False, 13), ("auto", True, 4), ("auto", False, 16), ("sqrt", True, 4), ("log2", True, 4), ("onethird", True, 6), ("20", True, 16)])
def test_features_of_a_node(strategy, forest, n):
    assert trees.features_of_a_node(strategy, 16, forest) == n


def test_scores_of_training_are_those_of_linking(spark, data):
    """Linking the records of the training takes their scores, which are the same as worked out again, whoever made the features."""
    r = fixture.Records(spark, data)
    params = {"gbt": {"maxIter": 3, "maxDepth": 3, "seed": 1}, "forest": {"numTrees": 3, "maxDepth": 3, "seed": 1}}
    settings = linkage.Settings(k=10, params=params, weights={"p_gbt": 0.5, "p_forest": 0.5})
    trained = linkage.train_and_validate(r.s1, r.s23, r.truth, F.substring(F.md5("entity_id"), 1, 1) < "c", settings)
    rows = lambda same: [sorted(map(tuple, df.select("s1_id", "target_id").collect())) for df in linkage.link(r.s1, r.s23, trained, settings, same)]
    assert rows(True) == rows(False)
    assert rows(True)[1]


def test_bundle_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [[float(i % 2), *[rng.random() + (i % 2) * 0.3 for _ in pairs.FEATURES]] for i in range(80)]
    df = spark.createDataFrame([[str(i), str(i), *r] for i, r in enumerate(rows)], ["s1_id", "target_id", "label", *pairs.FEATURES])
    folder = str(tmp_path / "bundle")
    assert linkage.Trained.load(folder) is None
    fitted = models.train_all(df, {"gbt": {"maxIter": 2, "maxDepth": 2, "seed": 1}, "logistic": {"C": 1.0, "maxIter": 5}})
    linkage.train_or_load(folder, lambda: linkage.Trained(fitted, {"p_gbt": 0.75, "p_logistic": 0.25}, 0.62))

    def never():
        raise AssertionError("trained again")

    again = linkage.train_or_load(folder, never)
    assert (again.weights, again.threshold, list(again.models)) == ({"p_gbt": 0.75, "p_logistic": 0.25}, 0.62, ["gbt", "logistic"])
    p = lambda m: models.predict(m, df).select("s1_id", "p_gbt", "p_logistic").orderBy("s1_id").collect()
    assert p(again.models) == p(fitted)


def test_tsv_keeps_rows_whole(spark, tmp_path):
    path = str(tmp_path / "x.tsv")
    rows = [("S1-1", "a\tb\r\nc", '"q" \\ x', "en"), ("S1-2", None, "", " fr ")]
    tables.write_tsv(spark.createDataFrame(rows, RECORDS), path)
    got = [tuple(r) for r in tables.read_tsv(spark, path).orderBy("entity_id").collect()]
    assert got == [("S1-1", "a b  c", '"q" \\ x', "en"), ("S1-2", "", "", " fr ")]


def test_link_files_of_some_countries(spark, data, tmp_path):
    r = fixture.Records(spark, data)
    for s in ("S1", "S2", "S3"):
        tables.write_tsv(r.sources.where(f"source = '{s}'").select(*schema.SOURCE_COLUMNS), str(tmp_path / f"{s}.tsv"))
    settings = linkage.Settings(k=10, threshold=0.4, countries=("en",))
    linkage.link_files(spark, str(tmp_path / "S1.tsv"), [str(tmp_path / "S2.tsv"), str(tmp_path / "S3.tsv")], str(tmp_path / "out"), linkage.word_jaccard, settings)
    files = [p for p in (tmp_path / "out" / "matching_results.tsv").iterdir() if p.name.startswith("part-")]
    lines = "".join(p.read_text() for p in files).splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids"
    assert sorted(x.split("\t")[0] for x in lines[1:]) == sorted(x.entity_id for x in r.s1.where("country = 'en'").collect())


def test_write_by_country(spark, tmp_path):
    df = spark.createDataFrame([("a", "en"), ("b", "fr"), ("c", "en")], "id string, country string")
    tables.write_by_country(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "country=en")).collect())) == [("a",), ("c",)]
