"""Training of Spark ML's tree ensembles from histograms: a task for each ensemble, or for some trees of a forest.

Spark ML runs a job for each level of each boosted tree, thousands of small jobs
for a few hundred rounds. Here the rows, as bin numbers of a byte each, are
broadcast and each ensemble grows where they are. What is learnt is the same:
variance (boosting, on the residuals of the logistic loss; the first tree has
weight 1) or Gini impurity (forests), the same parameters, Poisson weights for
bags and Bernoulli ones for subsampling, a drawn subset of features for each
node. Random draws and the places of splits differ from Spark's. The result is
a Spark ML model.

Scale. All rows take part. They are on the driver and in each training task as
bin numbers: about 16 bytes a pair for each number of bins. Rows are put in
order, so that runs agree if the places of splits do; these are exact for
features of at most SKETCH values in a partition.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession

from weftlink.llm._spark import shared_dir
from weftlink.llm._worker import give_back

#: Values of a feature that a partition hands on at most; beyond it, so many evenly spaced ones.
SKETCH = 1024
#: Trees of a forest that one task grows.
TREES = 25

KNOWN = {"maxIter", "numTrees", "stepSize", "maxDepth", "maxBins", "subsamplingRate", "featureSubsetStrategy", "seed"}
_NODE = "id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"


@dataclass
class Tree:
    """Nodes in the order in which they came; left is -1 for leaves. stats: weight, sum and sum of squares."""

    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    stats: np.ndarray


def features_of_a_node(strategy: str, n: int, forest: bool) -> int:
    """How many of n features a node draws, by Spark's rules."""
    strategy = {"auto": "sqrt" if forest else "all"}.get(strategy, strategy)
    named = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if re.fullmatch(r"[1-9]\d*", strategy) else math.ceil(float(strategy) * n)


def _histograms(codes: np.ndarray, slot: np.ndarray, rows: np.ndarray, w: np.ndarray, wt: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """(2, features, slots, bins): weights and weighted targets of the rows."""
    out = np.empty((2, len(codes), slots * bins))
    base, w, wt = slot * bins, w[rows], wt[rows]
    plain = bool((w == 1).all())
    for f, column in enumerate(codes):
        key = base + column[rows]
        out[0, f] = np.bincount(key, None if plain else w, slots * bins)
        out[1, f] = np.bincount(key, wt, slots * bins)
    return out.reshape(2, len(codes), slots, bins)


def grow(codes: np.ndarray, target: np.ndarray, w: np.ndarray, depth: int, bins: int, per_node: int, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """(tree, leaf of each row, also of rows without weight) from bin numbers (features, rows). The larger of two children has what its parent and the smaller one leave."""
    sampled, wt = np.flatnonzero(w), w * target
    at = np.zeros(len(target), np.int64)
    feature, code, left, gain = [-1], [-1], [-1], [0.0]
    active = np.zeros(1, np.int64)
    least = 1e-12 * float(wt @ target)
    table = _histograms(codes, np.zeros(len(sampled), np.int64), sampled, w, wt, 1, bins) if depth and len(sampled) else None
    for level in range(depth if table is not None else 0):
        (n, s), (low_n, low_s) = table[:, :1].sum(3, keepdims=True), table.cumsum(3)
        high_n, high_s = n - low_n, s - low_s
        with np.errstate(divide="ignore", invalid="ignore"):
            better = low_s**2 / low_n + high_s**2 / high_n - s**2 / n
        better[~((low_n > 0.5) & (high_n > 0.5))] = -np.inf
        if per_node < len(codes):
            out = np.argsort(rng.random((len(active), len(codes))), axis=1)[:, per_node:]
            better[out.ravel(), np.repeat(np.arange(len(active)), out.shape[1])] = -np.inf
        flat = better.transpose(1, 0, 2).reshape(len(active), -1)
        best = flat.argmax(1)
        found = flat[np.arange(len(active)), best]
        go = np.flatnonzero(found > least)
        if not len(go):
            break
        f, c = best[go] // bins, best[go] % bins
        first = len(feature) + 2 * np.arange(len(go))
        for i, node in enumerate(active[go]):
            feature[node], code[node], left[node], gain[node] = int(f[i]), int(c[i]), int(first[i]), float(found[go[i]] / n[0, go[i], 0])
        low = low_n[f, go, c]
        small = first + (low > n[0, go, 0] - low)
        split_of = np.full(len(feature), -1)
        split_of[active[go]] = np.arange(len(go))
        feature += [-1] * 2 * len(go)
        code += [-1] * 2 * len(go)
        left += [-1] * 2 * len(go)
        gain += [0.0] * 2 * len(go)
        split = split_of[at]
        rows = np.flatnonzero(split >= 0)
        split = split[rows]
        at[rows] = first[split] + (codes[f[split], rows] > c[split])
        active = np.concatenate([[x, x + 1] for x in first])
        if level + 1 < depth:
            small_of = np.full(len(feature), -1)
            small_of[small] = np.arange(len(go))
            slot = small_of[at[sampled]]
            there = np.flatnonzero(slot >= 0)
            less = _histograms(codes, slot[there], sampled[there], w, wt, len(go), bins)
            parent, second = table[:, :, go], (small > first)[None, None, :, None]
            table = np.stack([np.where(second, parent - less, less), np.where(second, less, parent - less)], 3).reshape(2, len(codes), -1, bins)
    stats = np.stack([np.bincount(at[sampled], x[sampled], len(feature)) for x in (w, wt, wt * target)], 1)
    for node in range(len(feature) - 1, -1, -1):
        if left[node] >= 0:
            stats[node] = stats[left[node]] + stats[left[node] + 1]
    return Tree(*map(np.array, (feature, code, left, gain)), stats), at


def boosted(codes: np.ndarray, label: np.ndarray, bins: int, depth: int, per_node: int, rate: float, seed: int, rounds: int, step: float) -> list[Tree]:
    sign = 2.0 * label - 1
    margin, target, out = np.zeros(len(sign)), sign, []
    for i in range(rounds):
        rng = np.random.default_rng([abs(seed), i])
        w = (rng.random(len(sign)) < rate).astype(float)
        tree, leaf = grow(codes, target, w, depth, bins, per_node, rng)
        out.append(tree)
        margin += (step if i else 1.0) * (tree.stats[:, 1] / np.maximum(tree.stats[:, 0], 1e-300))[leaf]
        with np.errstate(over="ignore"):
            target = 4 * sign / (1 + np.exp(2 * sign * margin))
    return out


def bagged(codes: np.ndarray, label: np.ndarray, bins: int, depth: int, per_node: int, rate: float, seed: int, trees: list[int]) -> list[Tree]:
    out = []
    for i in trees:
        rng = np.random.default_rng([abs(seed), i])
        out.append(grow(codes, label, rng.poisson(rate, len(label)).astype(float), depth, bins, per_node, rng)[0])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, value, n) of a partition."""
    held = list(batches)
    if sum(map(len, held)):
        table = pa.Table.from_batches(held)
        for f in range(1, table.num_columns):
            value, n = np.unique(np.asarray(table.column(f), np.float64), return_counts=True)
            if len(value) > SKETCH:
                ends = np.cumsum(n)
                at = np.unique(np.searchsorted(ends, np.linspace(1, ends[-1], SKETCH)))
                value, n = value[at], np.diff(ends[at], prepend=0)
            yield pa.record_batch([pa.array(np.full(len(value), f - 1, np.int32)), pa.array(value), pa.array(n.astype(np.int64))], ["f", "value", "n"])


def _places(value: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature is split: between all values, or evenly by their number."""
    value, of = np.unique(value, return_inverse=True)
    ends = np.cumsum(np.bincount(of.ravel(), n, len(value)))
    between = (value[:-1] + value[1:]) / 2
    if len(value) <= bins:
        return between
    at = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, bins) / bins))
    return between[at[at < len(between)]]


def _coded(rows: DataFrame, places: dict[int, list[np.ndarray]]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """({bins: bin numbers (features, rows)}, labels) of all rows, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.asarray(c, np.float64) for c in batch.columns]
            coded = [np.stack([np.searchsorted(p, x) for p, x in zip(by, columns[1:], strict=True)]).astype(np.uint16 if bins > 256 else np.uint8).tobytes() for bins, by in places.items()]
            yield pa.record_batch([pa.array([columns[0].tobytes()], pa.binary()), *[pa.array([x], pa.binary()) for x in coded]], ["label", *[f"b{b}" for b in places]])

    parts = rows.mapInArrow(run, ", ".join(["label binary", *[f"b{b} binary" for b in places]])).toArrow()
    label = np.concatenate([np.frombuffer(x, np.float64) for x in parts.column("label").to_pylist()])
    codes = {b: np.concatenate([np.frombuffer(x, np.uint16 if b > 256 else np.uint8).reshape(len(by), -1) for x in parts.column(f"b{b}").to_pylist()], axis=1) for b, by in places.items()}
    order = np.lexsort((label, *[x for c in codes.values() for x in c]))
    return {b: np.ascontiguousarray(c[:, order]) for b, c in codes.items()}, label[order]


def _model(spark: SparkSession, estimator: GBTClassifier | RandomForestClassifier, trees: list[Tree], places: list[np.ndarray]) -> GBTClassificationModel | RandomForestClassificationModel:
    """The Spark ML model of these trees, by way of its saved form."""
    forest = isinstance(estimator, RandomForestClassifier)
    nodes, about = [], []
    for t, tree in enumerate(trees):
        for i, (w, s, ss) in enumerate(tree.stats.tolist()):
            p = s / w if w else 0.0
            inner = tree.left[i] >= 0
            stats = [w - s, s] if forest else [w, s, ss]
            impurity = 2 * p * (1 - p) if forest else max(0.0, ss / w - p * p if w else 0.0)
            split = (int(tree.feature[i]), [float(places[tree.feature[i]][tree.code[i]])], -1) if inner else (-1, [], -1)
            left = int(tree.left[i])
            nodes.append((t, (i, float(p > 0.5) if forest else p, impurity, stats, round(w), float(tree.gain[i]) * (2 if forest else 1) if inner else -1.0, left, left + 1 if inner else -1, split)))
        kind = "classification.DecisionTreeClassificationModel" if forest else "regression.DecisionTreeRegressionModel"
        about.append((t, json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": f"tree_{t}", "paramMap": {"maxDepth": estimator.getMaxDepth()}, "defaultParamMap": {}}), 1.0 if forest or not t else estimator.getStepSize()))
    values = lambda m: {p.name: v for p, v in m.items()}
    model = RandomForestClassificationModel if forest else GBTClassificationModel
    facts = {
        "class": f"org.apache.spark.ml.classification.{model.__name__}", "timestamp": 0, "sparkVersion": spark.version, "uid": estimator.uid, "paramMap": values(estimator._paramMap), "defaultParamMap": values(estimator._defaultParamMap),
        "numFeatures": len(places), "numTrees": len(trees), **({"numClasses": 2} if forest else {}),
    }
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, f"treeID int, nodeData struct<{_NODE}>").coalesce(1).write.parquet(f"{path}/data")
    try:
        return model.load(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def train(rows: DataFrame, estimators: dict[str, GBTClassifier | RandomForestClassifier]) -> dict[str, GBTClassificationModel | RandomForestClassificationModel]:
    """A model for each estimator from rows of (label, features), labels 0 or 1, no nulls."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    found = rows.mapInArrow(_sketch, "f int, value double, n long").toArrow()
    f, value, n = (np.asarray(found.column(c)) for c in range(3))
    n_features = len(rows.columns) - 1
    places = {b: [_places(value[f == i], n[f == i], b) for i in range(n_features)] for b in sorted({e.getMaxBins() for e in estimators.values()})}
    codes, label = _coded(rows, places)
    if not np.isin(label, (0, 1)).all():
        raise ValueError("labels must be 0 or 1")
    jobs = []
    for name, e in estimators.items():
        forest = isinstance(e, RandomForestClassifier)
        common = (e.getMaxBins(), e.getMaxDepth(), features_of_a_node(e.getFeatureSubsetStrategy(), n_features, forest and e.getNumTrees() > 1), e.getSubsamplingRate(), e.getSeed())
        if forest:
            jobs += [(name, bagged, common, (list(range(a, min(a + TREES, e.getNumTrees()))),)) for a in range(0, e.getNumTrees(), TREES)]
        else:
            jobs.append((name, boosted, common, (e.getMaxIter(), e.getStepSize())))
    jobs.sort(key=lambda job: job[1] is bagged)  # boosting takes longest
    held = sc.broadcast((codes, label))

    def run(job: tuple) -> list[Tree]:
        _, grown, common, rest = job
        codes, label = held.value
        try:
            return grown(codes[common[0]], label, *common, *rest)
        finally:
            give_back()

    grown: dict[str, list[Tree]] = {name: [] for name in estimators}
    for job, trees in zip(jobs, sc.parallelize(jobs, len(jobs)).map(run).collect(), strict=True):
        grown[job[0]] += trees
    held.unpersist()
    return {name: _model(spark, e, grown[name], places[e.getMaxBins()]) for name, e in estimators.items()}
