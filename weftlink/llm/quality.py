"""Document quality by histogram gradient-boosted trees over statistics of the text.

Each text gives a row of numbers (shares of kinds of characters, lengths of
words and lines, repetition). Fitting takes a bounded labelled sample: features
are cut into at most ``BINS`` quantile bins, and trees of full depth are grown
level by level from histograms of gradients. The forest is flattened into
arrays (feature, threshold, leaf), and scoring walks all trees for a block of
documents with numpy indexing. Only the arrays are broadcast, some tens of kB.

Edge cases. Null and empty texts have all statistics 0 and are scored like any
other. A long text is read whole. Without labelled rows, or with one class
only, every score is the share of label 1 (0.5 without rows). Rows that repeat
are scored each. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import _spark, _text, _worker, labelled

#: Labelled documents used for fitting, at most.
SAMPLE = 12_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 48, 70, 4, 0.15, 2.0, 12.0
THRESHOLD = 0.7

_KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "bang", "bar", "sign", "other_mark", "multibyte")
_KIND = np.full(256, _KINDS.index("other_mark"), np.int64)
for _name, _members in (
    ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("newline", (10,)),
    ("stop", b".,;:"), ("bang", b"!?"), ("bar", b"|"), ("sign", b"*#$%&@^~+=<>_\\/"), ("multibyte", range(128, 256)),
):
    _KIND[list(_members)] = _KINDS.index(_name)

NAMES = (
    *(f"share_{k}" for k in _KINDS), "log_words", "word_length", "word_length_sd", "longest_word", "words_a_line", "log_lines",
    "distinct_words", "commonest_word", "same_as_before", "repeated_pairs", "repeated_fives", "capital_start", "mark_end", "short_words", "long_words", "distinct_lines",
)


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and how often its commonest occurs."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    head = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.append(head, len(key)))
    of = (key[head] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, runs)
    return np.bincount(of, minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    body, offsets = _text.utf8(column)
    return np.concatenate([_statistics(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _text.chunks(offsets)] or [np.zeros((0, len(NAMES)))])


def _statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(of_byte * len(_KINDS) + _KIND[body], minlength=n * len(_KINDS)).reshape(n, len(_KINDS))
    starts, ends, at = _text.word_spans(body, offsets)
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1).astype(float)
    length = (ends - starts).astype(float)
    mean = _per_doc(length, doc, n) / some
    spread = np.sqrt(np.maximum(_per_doc(length * length, doc, n) / some - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    hashes = _text.hash_spans(body, starts, ends)
    distinct, most = _distinct(hashes, doc, n)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    repeated = []
    for width in (2, 5):
        pos, of = _text.doc_windows(at, width)
        kept, _ = _distinct(_text.window_hashes(hashes, width)[pos], of, n)
        count = np.bincount(of, minlength=n)
        repeated.append((count - kept) / np.maximum(count, 1))
    lines = kinds[:, _KINDS.index("newline")] + 1.0
    cut = np.flatnonzero(body == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cut + 1]))
    line_start = line_start[line_start < len(body)]
    line_end = np.append(line_start[1:], len(body))
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_kinds, _ = _distinct(_text.hash_spans(body, line_start, line_end), line_doc, n)
    first, last = _KIND[body[starts]], _KIND[body[ends - 1]]
    marks = (last >= _KINDS.index("bang")) & (last <= _KINDS.index("other_mark"))
    return np.column_stack([
        kinds / size[:, None], np.log1p(words), mean, spread, np.log1p(longest), words / lines, np.log1p(lines), distinct / some, most / some, _per_doc(same, doc, n) / some, *repeated,
        _per_doc(first == _KINDS.index("upper"), doc, n) / some, _per_doc(marks, doc, n) / some, _per_doc(length <= 2, doc, n) / some, _per_doc(length >= 12, doc, n) / some, line_kinds / lines,
    ]) * (words > 0)[:, None]


@dataclass(frozen=True)
class Forest:
    """Full trees of one depth: inner nodes and leaves of each as rows of arrays; base: the score before the first tree, as log odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        if depth:
            total += self.leaf[tree, at - (2**depth - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss."""
    n, width = x.shape
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower")) for j in range(width)]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)])  # bin <= i: x <= edges[i]
    score = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            m = 2**level
            sums = np.stack([[np.bincount(node * BINS + bins[j], v, m * BINS).reshape(m, BINS) for v in (g, h)] for j in range(width)])
            left = np.cumsum(sums, -1)
            total = left[..., -1:]
            gl, hl = left[:, 0], left[:, 1]
            gr, hr = total[:, 0] - gl, total[:, 1] - hl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - total[:, 0] ** 2 / (total[:, 1] + RIDGE)
            gain[(hl < LEAST / 4) | (hr < LEAST / 4)] = 0
            flat = gain.transpose(1, 0, 2).reshape(m, -1)
            best = flat.argmax(1)
            for k in range(m):
                j, cut = divmod(int(best[k]), BINS)
                if flat[k, best[k]] > 1e-6 and cut < len(edges[j]):
                    feature[m - 1 + k], threshold[m - 1 + k] = j, edges[j][cut]
            at = m - 1 + node
            node = 2 * node + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + RIDGE)
        score += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(base, np.stack(features), np.stack(thresholds), np.stack(leaves))


@_worker.task
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(0))
        yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["x", "label"])


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of an id as text leaves 2 when divided by 4; such rows are not learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fits on at most limit labelled documents that are not held out."""
    rows = labelled.sample(docs, labels, label, limit, ~held_out(F.col(id_col)), id_col, text_col)
    got = rows.select("text", "label").mapInArrow(_rows, "x binary, label int").toArrow()
    x = np.frombuffer(b"".join(v.as_py() for v in got.column("x")), np.float64).reshape(-1, len(NAMES))
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same forest in whatever order rows arrive
    return fit(x[order], y[order])


def _predict(column: pa.Array, forest: Forest) -> np.ndarray:
    x = statistics(column)
    return np.concatenate([forest.predict(x[i : i + 1024]) for i in range(0, len(x), 1024)] or [np.zeros(0)])


@_worker.task
def _scored(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(_predict(batch.column(1), forest))], ["key", "score"])


@_worker.task
def _kept(batches: Iterator[pa.RecordBatch], forest: Forest, threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(0).field(at).cast(pa.string())
        yield batch.filter(pa.array(_predict(text, forest) >= threshold))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with score, the probability of label 1."""
    shared = _spark.with_small_batches(docs.sparkSession).sparkContext.broadcast(forest)
    source = docs.select(_spark.id_or_min(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(lambda it: _scored(it, shared.value), "key long, score double")
    return out.select(_spark.id_back("key").alias(id_col), "score")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns and without a shuffle."""
    shared = _spark.with_small_batches(docs.sparkSession).sparkContext.broadcast(forest)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)
    return rows.mapInArrow(lambda it: _kept(it, shared.value, threshold, at), rows.schema).select("row.*")
