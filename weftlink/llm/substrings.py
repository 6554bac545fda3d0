"""Exact removal of passages that already occurred earlier in the corpus.

Every window of ``width`` consecutive words gets a 64-bit Rabin-Karp hash. The
hashes are dealt out by their leading bits, each map task sending sorted,
delta-coded blocks in place of one row for each window, and each bucket counts
its hashes. All occurrences but the earliest (smallest doc_id, then smallest
start) are repeats; the repeats of a document merge into maximal intervals of
words, which are cut from its text.

Scale. A task holds one block (``BLOCK`` windows) or one bucket (about
``BUCKET`` windows). A window that many documents share reaches its bucket once
from each block, so a hot passage does not make a hot task. Beyond ``FANOUT``
buckets the blocks are dealt out in several rounds, each by a part of the bits.
Words are hashed by random numbers for (place, byte), windows by a polynomial over
those hashes; two different windows share a hash with a probability of about
2**-64, so of N windows about N*N/2**65 pairs do (of 10**9, 0.03).

Edge cases. Null and empty texts have no words. A text shorter than ``width``
has no window and stays. Rows with a null doc_id count as one smallest id. Rows
that repeat a doc_id share the removals of that id, clipped to their length.
A long text is cut in one task, whose memory grows with it. An empty table gives
no rows. Ties in (doc_id, start) are one place. Other columns of docs, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import _spark, _text, _worker
from weftlink.llm._packed import pack as _pack
from weftlink.llm._packed import unpack as _unpack

WIDTH = 20
BLOCK = 1_500_000
BUCKET = 1_000_000
FANOUT = 1024

_U = np.uint64
_REMOVED = "part int, payload binary"


def _pack_windows(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Sorted hashes with their places."""
    ids, of = np.unique(docs, return_inverse=True)
    return _pack(np.diff(hashes, prepend=_U(0)), np.diff(ids, prepend=np.int64(0)), of.astype(np.uint32), starts.astype(np.uint32))


def _unpack_windows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gaps, id_gaps, of, starts = _unpack(data)
    return np.cumsum(gaps, dtype=_U), np.cumsum(id_gaps)[of], starts.astype(np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; buckets are in the order of the hashes."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _earliest(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by hash: the rows with the earliest place of each hash, and those with later places."""
    order = np.argsort(hashes)
    h = hashes[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    several = same[1:] | same[:-1]
    at = np.flatnonzero(several)
    sub = order[at]
    order[at] = sub[np.lexsort((starts[sub], docs[sub], h[at]))]
    head = np.flatnonzero(~same[:-1])
    later = at[same[at]]
    place = np.searchsorted(head, later, "right") - 1
    first = order[head[place]]
    sub = order[later]
    differ = (docs[sub] != docs[first]) | (starts[sub] != starts[first])
    return order[head], sub[differ]


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    edges = np.append(np.flatnonzero(np.diff(part, prepend=part[:1] - 1)), len(part))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), int(a), int(b)


def _deal(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """A block's windows by bucket, each hash once; the block's own repeats go with some bucket under a sign of their own."""
    keep, repeats = _earliest(hashes, docs, starts)
    h, d, s = hashes[keep], docs[keep], starts[keep]
    for part, a, b in _runs(_bucket(h, buckets)):
        yield part, b"w" + _pack_windows(h[a:b], d[a:b], s[a:b])
    if len(repeats):
        yield int(hashes[repeats[0]] % _U(buckets)), b"r" + _pack(docs[repeats], starts[repeats].astype(np.uint32))


def _rows(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, payload in found:
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([payload], pa.binary())], ["part", "payload"])


@_worker.task
def _blocks(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        body, offsets = _text.utf8(batch.column(1))
        for a, b in _text.chunks(offsets):
            own = offsets[a : b + 1] - offsets[a]
            starts, ends, at = _text.word_spans(part := body[offsets[a] : offsets[b]], own)
            pos, doc = _text.doc_windows(at, width)
            hashes = _text.window_hashes(_text.hash_spans(part, starts, ends), width)[pos]
            held.append((hashes, ids[a:b][doc], (pos - at[doc]).astype(np.int64)))
            n += len(pos)
            if n >= BLOCK:
                yield from _rows(_deal(*map(np.concatenate, zip(*held, strict=True)), buckets))
                held, n = [], 0
    if n:
        yield from _rows(_deal(*map(np.concatenate, zip(*held, strict=True)), buckets))


@_worker.task
def _finer(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks that hold a part of the hashes, dealt out by more of the bits."""
    held, n = [], 0
    for batch in batches:
        for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = payload.as_py()
            if data[:1] == b"r":
                yield from _rows(iter([(part * (buckets // FANOUT), data)]))
                continue
            held.append(_unpack_windows(data[1:]))
            n += len(held[-1][0])
            if n >= BLOCK:
                yield from _rows(_deal(*map(np.concatenate, zip(*held, strict=True)), buckets))
                held, n = [], 0
    if n:
        yield from _rows(_deal(*map(np.concatenate, zip(*held, strict=True)), buckets))


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(_text.mix(docs.astype(np.int64).view(_U).copy()), buckets)


@_worker.group
def _count(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket of hashes: the places of repeats, by bucket of document."""
    docs, starts, windows = [], [], []
    for payload in table.column("payload"):
        data = payload.as_py()
        if data[:1] == b"r":
            d, s = _unpack(data[1:])
            docs.append(d)
            starts.append(s.astype(np.int64))
        else:
            windows.append(_unpack_windows(data[1:]))
    if windows:
        h, d, s = map(np.concatenate, zip(*windows, strict=True))
        del windows
        _, repeats = _earliest(h, d, s)
        docs.append(d[repeats])
        starts.append(s[repeats])
    d, s = np.concatenate(docs), np.concatenate(starts)
    part = _doc_bucket(d, buckets)
    order = np.lexsort((s, d, part))
    d, s, part = d[order], s[order], part[order]
    out = [(at, _pack(np.diff(d[a:b], prepend=np.int64(0)), s[a:b].astype(np.uint32))) for at, a, b in _runs(part)]
    return pa.table({"part": pa.array([x for x, _ in out], pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})


@_worker.group
def _merge(table: pa.Table, width: int) -> pa.Table:
    """Maximal intervals of words that repeated windows cover, a row for each document."""
    found = [_unpack(x.as_py()) for x in table.column("payload")]
    d = np.concatenate([np.cumsum(x[0]) for x in found])
    s = np.concatenate([x[1].astype(np.int64) for x in found])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + width)
    head = np.flatnonzero(new)
    tail = np.append(head[1:] - 1, len(d) - 1)
    doc, begins, ends = d[head], s[head], s[tail] + width
    at = np.append(np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)), len(doc))
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (begins, ends)]
    return pa.table({"key": pa.array(doc[at[:-1]], pa.int64()), "begins": lists[0], "ends": lists[1]})


def removal_intervals(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, begins, ends) of each document with repeats: words begins[i] to ends[i]-1, disjoint and in order, are to go. key: the id, _spark.NULL_ID for null."""
    _spark.with_small_batches(docs.sparkSession)
    source = docs.select(_spark.id_or_min(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    size = source.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * BUCKET)))
    rounds = [n]
    while rounds[0] > FANOUT:
        rounds.insert(0, -(-rounds[0] // FANOUT))
    for i in range(1, len(rounds)):
        rounds[i] = rounds[i - 1] * FANOUT
    dealt = source.mapInArrow(lambda it, b=rounds[0]: _blocks(it, width, b), _REMOVED)
    for b in rounds[1:]:
        dealt = dealt.repartition(min(b // FANOUT, 20_000), "part").mapInArrow(lambda it, b=b: _finer(it, b), _REMOVED)
    last = rounds[-1]
    # as many partitions as buckets, so that a task's share doesn't depend on the session
    parts = min(last, 20_000)
    spots = dealt.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _count(t, last), _REMOVED)
    return spots.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _merge(t, width), "key long, begins array<int>, ends array<int>")


@_worker.task
def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = _text.utf8(batch.column(1))
        begins, ends = batch.column(2), batch.column(3)
        out: list[tuple] = []
        for a, b in _text.chunks(offsets):
            part = body[offsets[a] : offsets[b]]
            first, last, at = _text.word_spans(part, offsets[a : b + 1] - offsets[a])
            kept = np.ones(len(first), bool)
            for i in np.flatnonzero(begins.is_valid().to_numpy(zero_copy_only=False)[a:b]):
                for x, y in zip(begins[a + int(i)].as_py(), ends[a + int(i)].as_py(), strict=True):
                    kept[at[i] + x : min(at[i] + y, at[i + 1])] = False
            out += _joined(part, first, last, at, kept)
        yield pa.record_batch(
            [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())],
            ["key", "n_words", "n_removed", "kept_text"],
        )


def _joined(body: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, kept: np.ndarray) -> Iterator[tuple]:
    """Words, words removed and the kept words joined by spaces, of each document."""
    out = np.append(body, np.uint8(0x20))
    take = np.zeros(len(out), bool)
    start, end = first[kept], last[kept]
    size = end - start
    take[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())] = True
    mark = np.searchsorted(np.flatnonzero(kept), at)
    inner = np.ones(len(start), bool)
    inner[mark[1:][mark[1:] > mark[:-1]] - 1] = False  # no space after a document's last word
    out[end[inner]] = 0x20
    take[end[inner]] = True
    text = out[take]
    width = size + inner
    reach = np.append(0, np.cumsum(width))[mark]
    for i in range(len(at) - 1):
        n = int(at[i + 1] - at[i])
        yield n, n - int(mark[i + 1] - mark[i]), text[reach[i] : reach[i + 1]].tobytes()


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_words, n_removed and kept_text: the words left, joined by one space."""
    cuts = removal_intervals(docs, width, id_col, text_col)
    source = docs.select(_spark.id_or_min(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    joined = source.join(cuts, "key", "left").select("key", "text", "begins", "ends")
    kept = joined.mapInArrow(_keep, "key long, n_words long, n_removed long, kept_text string")
    return kept.select(_spark.id_back("key").alias(id_col), "n_words", "n_removed", "kept_text")
