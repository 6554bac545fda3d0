"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the distinct lower-case words of a text and their first 4 to 6
bytes, each a 64-bit hash. The model has one weight for each feature, shared by
the ordered thresholds t1 < t2 < t3: P(grade >= k) = sigmoid(w.x - tk), and its
output is the expected grade, 0 (clean) to 3 (severe).

Fitting takes a bounded labelled sample. Document counts of features by label
are aggregated in Spark; features of label 1 with a clear excess are kept (at
most ``FEATURES``). Labels say only toxic or not, so the grade of a toxic
sample document is the third in which its number of distinct kept features falls
among the toxic ones. Weights and thresholds maximise the penalised ordinal likelihood.

Scoring is one pass over the texts with the kept features broadcast (at most
``FEATURES`` hashes and weights), without a shuffle.

Edge cases. Null and empty texts have no features and the lowest grade. Long
texts are read whole; a feature counts once a text, so length alone raises no
score. Without toxic labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import _spark, _text, _worker, labelled

#: Labelled documents used for fitting, at most.
SAMPLE = 20_000
FEATURES = 8192
GRADES = 4
#: A kept feature is in so many toxic documents at least, and the lower bound of its share of toxic documents is so far above the base rate.
LEAST, LIFT = 4, 3.0
PREFIXES = (4, 5, 6)
STEPS, RIDGE = 400, 0.3

_U = np.uint64
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), 39, 95]] = False


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk of texts: document and feature of each occurrence, and the number of words of each document."""
    body, offsets = _text.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in _text.chunks(offsets):
        part = body[offsets[a] : offsets[b]]
        starts, ends, at = _text.word_spans(part, offsets[a : b + 1] - offsets[a], _BREAK)
        doc = np.repeat(np.arange(b - a), np.diff(at))
        docs, hashes = [doc], [_text.hash_spans(part, starts, ends)]
        for n in PREFIXES:
            some = np.flatnonzero(ends - starts > n)
            docs.append(doc[some])
            hashes.append(_text.mix(_text.hash_spans(part, starts[some], starts[some] + n) ^ _U(n)))
        yield np.concatenate(docs), np.concatenate(hashes), np.diff(at)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


@_worker.task
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, docs) sums of each chunk."""
    for batch in batches:
        label, at = batch.column(1).to_numpy(), 0
        for doc, feature, words in _features(batch.column(0)):
            doc, feature = _distinct(doc, feature)
            ids, of = np.unique(feature, return_inverse=True)
            toxic = np.bincount(of, label[at + doc] > 0, len(ids)).astype(np.int64)
            at += len(words)
            yield pa.record_batch([pa.array(ids.view(np.int64)), pa.array(toxic), pa.array(np.bincount(of, minlength=len(ids)))], ["feature", "toxic", "docs"])


@dataclass(frozen=True)
class Model:
    """features in order, a weight for each, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def find(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of feature are known, and where."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == feature)
        return hit, at[hit]

    def grades(self, logit: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(-(logit[:, None] - self.thresholds[None, :])))


EMPTY = Model(np.zeros(0, _U), np.zeros(0), np.full(GRADES - 1, np.inf))


def _presence(column: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk: document and place of each known feature, once a document; and words by document."""
    for doc, feature, words in _features(column):
        hit, at = model.find(feature)
        one = np.unique(doc[hit] * max(1, len(model.features)) + at)
        yield one // max(1, len(model.features)), one % max(1, len(model.features)), words


@_worker.task
def _rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for doc, place, words in _presence(batch.column(0), model):
            lists = np.split(place.astype(np.int32), np.searchsorted(doc, np.arange(1, len(words))))
            label = batch.column(1).slice(at, len(words))
            at += len(words)
            yield pa.record_batch([pa.array([x.tolist() for x in lists], pa.list_(pa.int32())), label], ["places", "label"])


def fit(places: list[np.ndarray], grade: np.ndarray, features: np.ndarray) -> Model:
    """Penalised maximum likelihood of the cumulative-link model by Adam steps on weights and threshold gaps."""
    n, m = len(grade), len(features)
    doc = np.repeat(np.arange(n), [len(x) for x in places])
    at = np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int64)
    share = np.array([np.clip((grade >= k).mean(), 1e-6, 1 - 1e-6) for k in range(1, GRADES)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)))
    theta = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    step = np.arange(1, GRADES)
    for i in range(1, STEPS + 1):
        t = theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])
        z = np.bincount(doc, theta[at], n)
        up = np.column_stack([np.ones(n), 1 / (1 + np.exp(-(z[:, None] - t))), np.zeros(n)])
        rows = np.arange(n)
        high, low = up[rows, grade], up[rows, grade + 1]
        p = np.maximum(high - low, 1e-12)
        dz = (high * (1 - high) - low * (1 - low)) / p
        slope = np.zeros(GRADES - 1)
        for k in step:
            d = up[:, k] * (1 - up[:, k]) / p
            slope[k - 1] = d[grade == k - 1].sum() - d[grade == k].sum()
        tail = np.cumsum(slope[::-1])[::-1]
        g = np.concatenate([RIDGE * theta[:m] - np.bincount(at, dz[doc], m), [-tail[0]], -tail[1:] * np.exp(theta[m + 1 :])])
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        theta = theta - 0.05 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
    t = theta[m] + np.concatenate([[0.0], np.cumsum(np.exp(theta[m + 1 :]))])
    return Model(features, theta[:m], t)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most limit labelled documents."""
    rows = labelled.sample(docs, labels, label, limit, None, id_col, text_col).select("text", "label")
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)).alias("toxic")).first()
    if not whole.toxic or whole.toxic == whole.n:
        return EMPTY
    base = whole.toxic / whole.n
    counts = rows.mapInArrow(_count, "feature long, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    # one toxic and several clean documents more, as a cautious share
    lift = (F.col("toxic") - 1) / (F.col("docs") + 2) / F.lit(base)
    kept = counts.where((F.col("toxic") >= LEAST) & (lift >= LIFT)).orderBy(F.desc("toxic"), "feature").limit(FEATURES).toArrow()
    features = np.sort(kept.column("feature").to_numpy().view(_U))
    if not len(features):
        return EMPTY
    known = rows.sparkSession.sparkContext.broadcast(Model(features, np.zeros(len(features)), EMPTY.thresholds))
    got = rows.mapInArrow(lambda it: _rows(it, known.value), "places array<int>, label int").toArrow()
    toxic = got.column("label").to_numpy() > 0
    places = [np.array(x, np.int32) for x in got.column("places").to_pylist()]
    order = sorted(range(len(places)), key=lambda i: (toxic[i], places[i].tolist()))
    toxic, places = toxic[order], [places[i] for i in order]
    found = np.array([len(x) for x in places])
    cuts = np.quantile(found[toxic], [1 / 3, 2 / 3])
    return fit(places, np.where(toxic, 1 + np.searchsorted(cuts, found, "left"), 0), features)


@_worker.task
def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, place, words in _presence(batch.column(1), model):
            up = model.grades(np.bincount(doc, model.weights[place], len(words)))
            out.append(np.column_stack([up[:, 0], up.sum(1), (up >= 0.5).sum(1)]))
        x = np.concatenate(out or [np.zeros((0, 3))])
        yield pa.record_batch([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32))], ["key", "p_toxic", "severity", "grade"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with p_toxic, P(grade >= 1); severity, the expected grade; and grade, the highest with P(grade >= k) at least a half."""
    shared = _spark.with_small_batches(docs.sparkSession).sparkContext.broadcast(model)
    source = docs.select(_spark.id_or_min(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(lambda it: _scored(it, shared.value), "key long, p_toxic double, severity double, grade int")
    return out.select(_spark.id_back("key").alias(id_col), "p_toxic", "severity", "grade")
