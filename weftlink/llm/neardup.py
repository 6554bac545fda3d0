"""Near-duplicate classes by improved consistent weighted sampling of TF-IDF shingles.

A shingle is five consecutive words (all words of a shorter text), as a 48-bit
hash. Its weight is its count in the document times ``ln(1 + docs / df)`` with its
exact number of documents df. Counting goes by blocks: each task packs the
shingles of about ``BLOCK`` windows, deals the distinct ones out by their leading
bits as sorted, delta-coded lists, each bucket sums what it gets and answers each
block with the counts above one. So no row is made for a single shingle, a
frequent one reaches its bucket once from each block, and nothing is broadcast.

Each document keeps, for each of BANDS * ROWS samples, the smallest sampling
value over its shingles, which two documents share with a probability of their
weighted Jaccard similarity. Documents that agree in all samples of a band meet
in a bucket. The bands are taken in ``PHASES``; each compares only buckets that
still hold several classes, so copies are moved once and not once a band. In a
bucket the samples give an estimate for every two members, and a walk from member
to member compares each reached one exactly, by whole weighted shingle sets, with
all those not reached yet whose estimate is ``ESTIMATE`` or more: no link between
members is missed. A bucket over ``CAP`` members or ``HEAP`` bytes is cut into
blocks by a hash of the document before its members meet their sets. What such
a bucket then still holds in several classes meets in tasks of two blocks each,
however many those are. Links form classes by connected components.

Edge cases. Null and empty texts, and texts of separators only, are classes of
their own. Texts, not ids, are compared: rows that repeat an id, and rows without
one, each fall in the class of their own text. A class is named by its smallest
id; ids that are null come last, and a class of null ids alone has the name null.
Repeated rows are copies of each other. A long text is one block however long,
and a bucket of long texts is cut by their bytes. An empty table gives no rows.
Other columns may have any names. Of ties in the order of rows to keep, any row
is as good: they are equal in id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from weftlink.llm import _spark, _text, _worker, components
from weftlink.llm._packed import pack, unpack

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Bands that are compared together.
PHASES = ((0, 1), (1, 4), (4, BANDS))
#: Members and bytes of shingle sets that are compared in one task.
CAP, HEAP = 2048, 16 << 20
#: Estimates below this are no candidates: the samples' standard error at 0.8 is about 0.07.
ESTIMATE = 0.5
#: Shingles of a block, and those that a bucket counts.
BLOCK, BUCKET = 600_000, 800_000
#: Buckets dealt out to at once; more are reached in several rounds.
FANOUT = 1024

_U = np.uint64
_BITS = _U(48)
_K = BANDS * ROWS
_WHOLE, _COUNTS, _WANTED = 0, 1, 2


def _shingles(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order of document (at most 2**16 of them): document, id, count; then the word hashes and their offsets."""
    starts, ends, at = _text.word_spans(body, offsets)
    words = _text.hash_spans(body, starts, ends)
    pos, doc = _text.doc_windows(at, SHINGLE)
    found, docs = [_text.window_hashes(words, SHINGLE)[pos]], [doc]
    n = np.diff(at)
    for width in range(1, SHINGLE):
        if len(short := np.flatnonzero(n == width)):
            found.append(_text.window_hashes(words, width)[at[short]])
            docs.append(short)
    key = np.sort(np.concatenate(docs).astype(_U) << _BITS | np.concatenate(found) >> (_U(64) - _BITS))
    head = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> _BITS).astype(np.int64), key & ((_U(1) << _BITS) - _U(1)), count, words, at


def _digests(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two numbers for the word sequence of each document."""
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
        up, down = _text._WORDS.get(len(words) + 1)
        total = np.append(_U(0), np.cumsum(_text.mix(words ^ _U(salt)) * up[: len(words)]))
        out.append(((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(_U) * _U(salt)).view(np.int64))
    return out


@_worker.task
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, payload, docs, shingles) from (key, tag, text). Documents are numbered by task and row; a block's number is its first document's."""
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 40
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        key, tag, d1, d2, size, ids, count = map(np.concatenate, zip(*held, strict=True))
        payload = pack(key, tag, d1, d2, size, np.diff(ids, prepend=_U(0)), count)
        yield pa.record_batch([pa.array([x]) for x in (first, payload, len(key), len(ids))], ["block", "payload", "docs", "shingles"])

    for batch in batches:
        body, offsets = _text.utf8(batch.column(2))
        keys, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for low, high in _text.chunks(offsets):
            for a in range(low, high, 1 << 16):
                b = min(high, a + (1 << 16))
                doc, ids, count, words, at = _shingles(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.bincount(doc, minlength=b - a).astype(np.uint32)
                held.append((keys[a:b], tags[a:b], *_digests(words, at), size, ids, count.astype(np.uint32)))
                n += len(ids)
                if n >= BLOCK:
                    yield from out()
                    first += sum(len(x[0]) for x in held)
                    held, n = [], 0
    if held:
        yield from out()


def _part(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each id; buckets are in the order of the ids."""
    return ((ids >> _U(16)) * _U(buckets) >> _U(32)).astype(np.int64)


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    edges = np.append(np.flatnonzero(np.diff(part, prepend=part[:1] - 1)), len(part))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), int(a), int(b)


def _dealt(ids: np.ndarray, of: np.ndarray, docs: np.ndarray, blocks: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(part, payload): ids in order, whose block is blocks[of], with the documents of that block that have them."""
    for part, a, b in _runs(_part(ids, buckets)):
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([pack(np.diff(ids[a:b], prepend=_U(0)), of[a:b].astype(np.uint32), docs[a:b].astype(np.uint32), blocks)], pa.binary())], ["part", "payload"])


@_worker.task
def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, _, _, _, _, gaps, _ = unpack(payload.as_py())
            ids, docs = np.unique(np.cumsum(gaps, dtype=_U), return_counts=True)
            if len(ids):
                yield from _dealt(ids, np.zeros(len(ids), np.uint32), docs, np.array([block]), buckets)


def _gathered(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids in order, their place in blocks, documents, blocks."""
    ids, of, docs, blocks, n = [], [], [], [], 0
    for x in payloads:
        gaps, place, count, origin = unpack(x)
        ids.append(np.cumsum(gaps, dtype=_U))
        of.append(place.astype(np.int64) + n)
        docs.append(count)
        blocks.append(origin)
        n += len(origin)
    i, o, d, b = map(np.concatenate, (ids, of, docs, blocks))
    order = np.argsort(i, kind="stable")
    return i[order], o[order], d[order], b


@_worker.task
def _finer(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The same, dealt out by more of the bits."""
    held: list[bytes] = []
    n = 0
    for batch in batches:
        for payload in batch.column(1):
            held.append(payload.as_py())
            n += len(held[-1])
            if n >= 4 * BLOCK:
                yield from _dealt(*_gathered(held), buckets)
                held, n = [], 0
    if held:
        yield from _dealt(*_gathered(held), buckets)


@_worker.group
def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, its ids that several documents have, with their exact number."""
    ids, of, docs, blocks = _gathered([x.as_py() for x in table.column("payload")])
    head = np.flatnonzero(np.diff(ids, prepend=~ids[:1]))
    df = np.repeat(np.add.reduceat(docs.astype(np.int64), head), np.diff(np.append(head, len(ids))))
    several = np.flatnonzero(df > 1)
    several = several[np.argsort(blocks[of[several]], kind="stable")]  # ids stay in order within a block
    block = blocks[of[several]]
    rows = [(x, pack(np.diff(ids[several[a:b]], prepend=_U(0)), df[several[a:b]].astype(np.uint32))) for x, a, b in _runs(block)]
    return pa.table({"block": pa.array([x for x, _ in rows], pa.int64()), "payload": pa.array([x for _, x in rows], pa.binary())})


def document_counts(blocks: DataFrame, shingles: int) -> DataFrame:
    """(block, payload): counts of the shingles of each block that are in more than one document of the corpus."""
    rounds = [max(1, -(-shingles // BUCKET))]
    while rounds[0] > FANOUT:
        rounds.insert(0, -(-rounds[0] // FANOUT))
    for i in range(1, len(rounds)):
        rounds[i] = rounds[i - 1] * FANOUT
    kind = "part int, payload binary"
    dealt = blocks.select("block", "payload").mapInArrow(lambda it, b=rounds[0]: _deal(it, b), kind)
    for b in rounds[1:]:
        dealt = dealt.repartition(min(b // FANOUT, 20_000), "part").mapInArrow(lambda it, b=b: _finer(it, b), kind)
    # as many partitions as buckets, so that a task's share doesn't depend on the session
    dealt = dealt.repartition(min(rounds[-1], 20_000), "part")
    return dealt.groupBy("part").applyInArrow(lambda t: _count(t), "block long, payload binary")


def _weights(ids: np.ndarray, count: np.ndarray, payloads: list[bytes], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have each shingle, and its weight."""
    df = np.ones(len(ids), np.int64)
    found = [unpack(x) for x in payloads]
    if found:
        known = np.concatenate([np.cumsum(x[0], dtype=_U) for x in found])
        order = np.argsort(known)
        known, n = known[order], np.concatenate([x[1] for x in found])[order]
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        df = np.where(known[at] == ids, n[at], 1).astype(np.int64)
    return df, count * np.log(1 + docs / df)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, whose CDF is 1 - exp(-x) * (1 + x)."""
    u = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(70):
        mid = (low + high) / 2
        less = 1 - np.exp(-mid) * (1 + mid) < u
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


class _Sampler:
    """Improved consistent weighted sampling with variates read from tables of 2**16 quantiles."""

    def __init__(self) -> None:
        g = _gamma_quantiles(1 << 16)
        self.r, self.log_c = g.astype(np.float32), np.log(g).astype(np.float32)
        self.beta = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        seeds = _text.mix(np.arange(1, 2 * _K + 1, dtype=_U))
        self.mult, self.add = seeds[:_K] | _U(1), seeds[_K:]

    def sample(self, ids: np.ndarray, weights: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The smallest ln a over each document's shingles for all samples; heads: where documents begin."""
        out = np.empty((len(heads), _K), np.float32)
        log_w = np.log(weights).astype(np.float32)
        for k in range(_K):
            z = ids * self.mult[k] + self.add[k]
            z ^= z >> _U(31)
            z *= _U(0x9FB21C651E98DF25)
            z ^= z >> _U(28)
            z *= _U(0x9FB21C651E98DF25)
            field = z.view(np.uint16).reshape(-1, 4)
            r = self.r[field[:, 3]]
            beta = self.beta[field[:, 2]]
            t = log_w / r
            t += beta
            np.floor(t, out=t)
            t -= beta
            t += 1
            t *= r
            out[:, k] = np.minimum.reduceat(self.log_c[field[:, 1]] - t, heads)
        return out


_sampler: list[_Sampler] = []


def _opened(table: pa.Table) -> tuple[int, list[np.ndarray], list[bytes], np.ndarray]:
    """Of the rows of one block: its number, its arrays, the counts, and the documents wanted."""
    kind, payload, rids = table.column("kind").to_numpy(), table.column("payload"), table.column("rids")
    whole = unpack(payload[int(np.flatnonzero(kind == _WHOLE)[0])].as_py())
    wanted = [rids[int(i)].values.to_numpy() for i in np.flatnonzero(kind == _WANTED)]
    return table.column("block")[0].as_py(), whole, [payload[int(i)].as_py() for i in np.flatnonzero(kind == _COUNTS)], np.concatenate([np.zeros(0, np.int64), *wanted])


@_worker.group
def _sketch(table: pa.Table, docs: int) -> pa.Table:
    """(rid, block, key, tag, d1, d2, size, sig) of the documents of one block; sig is null where there are no words."""
    if not _sampler:
        _sampler.append(_Sampler())
    block, (key, tag, d1, d2, sizes, gaps, count), counts, _ = _opened(table)
    ids = np.cumsum(gaps, dtype=_U)
    _, weights = _weights(ids, count, counts, docs)
    some = np.flatnonzero(sizes)
    heads = (np.cumsum(sizes, dtype=np.int64) - sizes)[some]
    signs = np.empty((len(some), _K), np.float32)
    for a, b in _text.chunks(np.append(heads, len(ids)), 1 << 16):
        lo, hi = heads[a], heads[b] if b < len(heads) else len(ids)
        signs[a:b] = _sampler[0].sample(ids[lo:hi], weights[lo:hi], heads[a:b] - lo)
    sig = np.full(len(sizes), None, object)
    sig[some] = [x.tobytes() for x in signs]
    rid = block + np.arange(len(sizes))
    return pa.table({"rid": rid, "block": np.full(len(rid), block), "key": key, "tag": tag, "d1": d1, "d2": d2, "size": sizes.astype(np.int64), "sig": pa.array(sig, pa.binary())})


@_worker.group
def _sets(table: pa.Table, docs: int) -> pa.Table:
    """(rid, set) of the wanted documents of one block: packed ids, counts and document counts."""
    block, (_, _, _, _, sizes, gaps, count), counts, wanted = _opened(table)
    out = []
    if len(wanted):
        ids = np.cumsum(gaps, dtype=_U)
        df, _ = _weights(ids, count, counts, docs)
        ends = np.cumsum(sizes, dtype=np.int64)
        for i in np.sort(wanted - block):
            a, b = ends[i] - sizes[i], ends[i]
            out.append((block + int(i), pack(np.diff(ids[a:b], prepend=_U(0)), count[a:b], df[a:b].astype(np.uint32))))
    return pa.table({"rid": pa.array([x for x, _ in out], pa.int64()), "set": pa.array([x for _, x in out], pa.binary())})


class _Members:
    """Members of some buckets with their weighted shingle sets: ids, weight and start of each member's shingles."""

    def __init__(self, com: np.ndarray, sig: np.ndarray, sets: list[bytes], docs: int) -> None:
        found = [unpack(x) for x in sets]
        self.com, self.sig, self.n = com, sig, len(com)
        self.ids = np.concatenate([np.cumsum(x[0], dtype=_U) for x in found])
        self.weight = np.concatenate([x[1] for x in found]) * np.log(1 + docs / np.concatenate([x[2] for x in found]))
        sizes = np.array([len(x[0]) for x in found])
        self.start = np.append(0, np.cumsum(sizes))
        self.total = np.add.reduceat(self.weight, self.start[:-1])


def _pairs(m: _Members) -> list[tuple[int, int]]:
    """Links of buckets of two, whose members are next to each other."""
    a, b, pair = m.sig[0::2], m.sig[1::2], np.arange(m.n // 2)
    sizes = np.diff(m.start)
    of = np.repeat(np.arange(m.n), sizes)
    place = np.unique(m.ids, return_inverse=True)[1] + (of // 2) * len(m.ids)
    even = of % 2 == 0
    _, i, j = np.intersect1d(place[even], place[~even], assume_unique=True, return_indices=True)
    low = np.bincount((of[even] // 2)[i], np.minimum(m.weight[even][i], m.weight[~even][j]), m.n // 2)
    close = ((a == b).sum(1) >= ESTIMATE * _K) & (low / (m.total[0::2] + m.total[1::2] - low) >= SIMILARITY)
    return [(int(m.com[2 * x]), int(m.com[2 * x + 1])) for x in pair[close]]


def _linked(m: _Members) -> list[tuple[int, int]]:
    """Links that span the classes of the members of one block: every two of different com are compared unless a link found earlier joins them."""
    n, shingle = m.n, np.unique(m.ids, return_inverse=True)[1]
    label = np.unique(m.com, return_inverse=True)[1]
    order = np.argsort(label, kind="stable")
    group = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    left, own = np.ones(n, bool), np.zeros(shingle.max() + 1)
    links = []
    for seed in range(n):
        reached = group[label[seed]].tolist() if left[seed] else []
        left[reached] = False
        while reached:
            at = reached.pop()
            near = np.flatnonzero(left)
            near = near[(m.sig[near] == m.sig[at]).sum(1) >= ESTIMATE * _K]
            mine = slice(m.start[at], m.start[at + 1])
            own[shingle[mine]] = m.weight[mine]
            ends = np.append(0, np.cumsum(m.start[near + 1] - m.start[near]))
            for a, b in _text.chunks(ends):
                some, heads = near[a:b], ends[a:b] - ends[a]
                pos = np.repeat(m.start[some] - heads, np.diff(ends[a : b + 1])) + np.arange(ends[b] - ends[a])
                low = np.add.reduceat(np.minimum(m.weight[pos], own[shingle[pos]]), heads)
                for x in some[low / (m.total[at] + m.total[some] - low) >= SIMILARITY]:
                    if left[x]:
                        links.append((int(m.com[seed]), int(m.com[x])))
                        left[group[label[x]]] = False
                        reached.extend(group[label[x]].tolist())
            own[shingle[mine]] = 0
    return links


@_worker.task
def _compare(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between classes from rows (bk, x, y, com, sig, set) that lie together by (bk, x, y)."""
    held: list[tuple] = []  # rows of whole blocks of two
    block: list[tuple] = []

    def members(rows: list[tuple]) -> _Members:
        sig = np.frombuffer(b"".join(r[4] for r in rows), np.float32).reshape(len(rows), _K)
        return _Members(np.array([r[3] for r in rows]), sig, [r[5] for r in rows], docs)

    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f(x) for x in links], pa.int64()) for f in (min, max)], ["a", "b"])

    def closed() -> Iterator[pa.RecordBatch]:
        if len({r[3] for r in block}) > 1:
            if len(block) == 2:
                held.extend(block)
            else:
                yield out(_linked(members(block)))
        block.clear()
        if sum(len(r[5]) for r in held) > 2 << 20:
            yield out(_pairs(members(held)))
            held.clear()

    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if block and block[-1][:3] != row[:3]:
                    yield from closed()
                block.append(row)
    yield from closed()
    if held:
        yield out(_pairs(members(held)))


def _links(blocks: DataFrame, sets: DataFrame, docs: int) -> DataFrame:
    """(a, b) between classes of members of the same block. blocks: (bk, x, y, rid, com); sets: (rid, sig, set)."""
    rows = blocks.join(sets, "rid").select("bk", "x", "y", "com", "sig", "set")
    rows = rows.repartition("bk", "x", "y").sortWithinPartitions("bk", "x", "y")
    return rows.mapInArrow(lambda it: _compare(it, docs), "a long, b long")


def _blocks_of(n: Column, size: Column) -> Column:
    """Blocks by a hash hold half of CAP and of HEAP on average, so that two of them make a task. A shingle takes about 6 bytes."""
    return F.greatest(F.ceil(n * 2 / CAP), F.ceil(size * 12 / HEAP), F.lit(1)).cast("long")


def _hot(n: Column, size: Column) -> Column:
    return (n > CAP) | (size * 6 > HEAP)


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """state (rid, size, com) with the classes that links join made one."""
    links = _spark.written(links.distinct(), "links")
    if links.isEmpty():
        return state
    classes = components.connected_components(links)
    out = _spark.written(state.join(classes, F.col("com") == F.col("id"), "left").select("rid", "size", F.coalesce("component", "com").alias("com")), "classes")
    _spark.drop(state, links, classes)
    return out


def _open(members: DataFrame) -> DataFrame:
    """(bk, n, all) of the buckets that hold several classes, one of those with equal members. members: (bk, rid, size, com)."""
    same = ["n", "all", "low", "high", "mark"]
    sums = members.groupBy("bk").agg(
        F.count("*").alias("n"), F.sum("size").alias("all"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.bit_xor(F.xxhash64("rid")).alias("mark"), F.min("com").alias("c0"), F.max("com").alias("c1"),
    )
    return sums.where("c0 != c1").groupBy(*same).agg(F.min("bk").alias("bk")).select("bk", "n", "all")


def _classes(members: DataFrame, state: DataFrame, sets: DataFrame, docs: int) -> DataFrame:
    """(rid, size, com): the smallest rid of the class of each member. state: the same with each in a class of its own."""
    n, size = F.col("n"), F.col("all")
    for low, high in PHASES:
        some = members.where((F.col("band") >= low) & (F.col("band") < high)).select("bk", "rid").join(state, "rid")
        x = F.when(_hot(n, size), F.pmod(F.xxhash64("rid", F.lit(low)), _blocks_of(n, size))).otherwise(F.lit(0).cast("long"))
        blocks = some.join(_open(some), "bk").select("bk", x.alias("x"), F.lit(0).cast("long").alias("y"), "rid", "com")
        state = _merged(state, _links(blocks, sets, docs))
    every = members.select("bk", "rid").join(state, "rid")
    hot = _spark.written(every.join(_open(every).where(_hot(n, size)).select("bk"), "bk"), "hot")
    if hot.isEmpty():
        return state
    out = _merged(state, _links(_across(hot), sets, docs))
    _spark.drop(hot)
    return out


def _across(hot: DataFrame) -> DataFrame:
    """Blocks in which every member of a hot bucket outside its largest class meets every member of another class. hot: (bk, rid, size, com)."""
    sizes = hot.groupBy("bk", "com").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sizes = sizes.groupBy("bk").agg(F.max(F.struct("n", "com", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    inside, outside = _blocks_of(F.col("most.n"), F.col("most.s")), _blocks_of(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s"))
    mine = lambda n: F.pmod(F.xxhash64("rid", F.lit(-1)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    both = hot.drop("size").join(sizes, "bk")
    rest = both.where("com != most.com")
    one = both.where("com = most.com").select("bk", mine(inside).alias("x"), each(outside).alias("y"), "rid", "com")
    two = rest.select("bk", each(inside).alias("x"), mine(outside).alias("y"), "rid", "com")
    # Blocks outside the largest class meet each other where x is below 0; what shares a block meets in each task of that block.
    other = rest.select("bk", mine(outside).alias("i"), each(outside).alias("j"), "rid", "com").where("i != j")
    three = other.select("bk", (-1 - F.least("i", "j")).alias("x"), F.greatest("i", "j").alias("y"), "rid", "com")
    return one.union(two).union(three)


def _by_block(n: int, *kinds: tuple[int, DataFrame]) -> GroupedData:
    """Tables (block, payload) or (block, rids) as one (block, kind, payload, rids), by block, in as many partitions as there are blocks."""
    rows = [df.select("block", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("payload", "binary"), ("rids", "array<long>")))) for kind, df in kinds]
    out = rows[0]
    for df in rows[1:]:
        out = out.union(df)
    return out.repartition(min(max(n, 1), 20_000), "block").groupBy("block")


def _members(reps: DataFrame) -> DataFrame:
    """(bk, band, rid) of the buckets with several members, from (rid, sig)."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bk")))
    bands = reps.select("rid", F.explode(keys).alias("x")).select("x.bk", "x.band", "rid")
    several = bands.groupBy("bk").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high")
    return bands.join(several.select("bk"), "bk")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(key, rid, d1, d2, words) of each row, and (d1, d2, no_id, key, tag) of each text with words: its class's document of the smallest id.

    tag is a hash of the text; key is the id, _spark.NULL_ID for null, and no_id whether it is null.
    """
    spark = _spark.with_small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(_spark.id_or_min(id_col).alias("key"), F.xxhash64(text).alias("tag"), text.alias("text"))
    blocks = _spark.written(source.mapInArrow(_blocks, "block long, payload binary, docs long, shingles long"), "blocks")
    n = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("shingles"), F.lit(0)).alias("shingles"), F.count("*").alias("blocks")).first()
    total = n.docs
    counts = _spark.written(document_counts(blocks, n.shingles), "counts")
    _spark.free_shuffles(spark)
    sketched = _by_block(n.blocks, (_WHOLE, blocks), (_COUNTS, counts)).applyInArrow(lambda t: _sketch(t, total), "rid long, block long, key long, tag long, d1 long, d2 long, size long, sig binary")
    sketches = _spark.written(sketched, "sketches")
    _spark.free_shuffles(spark)
    best = F.struct((F.col("key") == _spark.NULL_ID).alias("no_id"), "key", "tag")
    texts = sketches.where("sig is not null").groupBy("d1", "d2").agg(F.min(F.struct("rid", "block", "size", "sig")).alias("x"), F.min(best).alias("best"))
    reps = _spark.written(texts.select("d1", "d2", "x.*", "best"), "reps")
    members = _spark.written(_members(reps.select("rid", "sig")), "members")
    own = reps.join(members.select("rid").distinct(), "rid", "left_semi")
    wanted = own.groupBy("block").agg(F.collect_list("rid").alias("rids"))
    sets = _by_block(n.blocks, (_WHOLE, blocks), (_COUNTS, counts), (_WANTED, wanted)).applyInArrow(lambda t: _sets(t, total), "rid long, set binary")
    sets = _spark.written(sets.join(reps.select("rid", "sig"), "rid"), "sets")
    _spark.drop(blocks, counts)
    _spark.free_shuffles(spark)
    state = _classes(members, _spark.written(own.select("rid", "size", F.col("rid").alias("com")), "classes"), sets, total)
    _spark.drop(sets, members)
    of = reps.select("d1", "d2", "rid", "best").join(state.select("rid", "com"), "rid", "left").select("d1", "d2", "best", F.coalesce("com", "rid").alias("com"))
    first = of.groupBy("com").agg(F.min("best").alias("best"))
    named = of.select("d1", "d2", "com").join(first, "com").select("d1", "d2", "best.*")
    return sketches.select("key", "rid", "d1", "d2", F.col("sig").isNotNull().alias("words")), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with class_id, the smallest id of its class of near duplicates (its own, if it has none)."""
    rows, named = _classified(docs, id_col, text_col)
    named = named.select("d1", "d2", F.col("key").alias("class_key"))
    out = rows.select("key", "d1", "d2").where("words").join(named, ["d1", "d2"], "left").union(rows.where("not words").select("d1", "d2", "key", F.col("key").alias("class_key")))
    return out.select(_spark.id_back("key").alias(id_col), _spark.id_back("class_key").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each class one row of the smallest id. Rows without words stay."""
    _, named = _classified(docs, id_col, text_col)
    kept = named.select("key", "tag").distinct()
    text = F.col(text_col).cast("string")
    row = F.struct(*[docs[c] for c in docs.columns])
    words = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = docs.select(row.alias("row"), _spark.id_or_min(id_col).alias("key"), F.xxhash64(text).alias("tag"), words.alias("words"))
    one = rows.where("words").join(kept, ["key", "tag"], "left_semi").groupBy("key", "tag").agg(F.first("row").alias("row"))
    return one.select("row.*").union(rows.where("not words").select("row.*"))
