"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. The last token of the BPE encoding of each prefix of a piece is
unique, and a sequence of tokens is an encoding if and only if every two
neighbours encode to themselves. So reading a piece byte by byte it is enough to
know, for each position from which a later token can still start (the bytes
after it begin some token), the last token that ends there. Those positions lie
within the longest token of the end, which bounds the lookahead. Once all of
them descend from one earlier position the tokens up to it are final and are
emitted. A state of the transducer is what is pending relative to that
position; states and transitions are made when first met and kept in a table
that is emptied when it grows beyond ``STATES``; the state at a piece's end is not kept. Whole pieces already read are
kept in two generations of at most ``PIECES`` each.

Decoding. Token bytes run through the UTF-8 automaton of the well-formed byte
sequences; characters are given out as soon as they are complete. Ids come in
portions of any size, and only the automaton's state is kept between them.

Edge cases. A null text is an empty one and has no tokens. Text that looks like
a special token is ordinary text. Ids outside the vocabulary raise KeyError.
Rows that repeat, in id or text, are encoded each; a null id stays null. A long
text is encoded alone: memory is bounded by the longest document and the tables
of states, moves, pairs and pieces. An empty table gives no rows. Other columns
of docs, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import _spark, _text, _worker
from weftlink.llm.tokenizer_spec import Spec, default_spec, ranks

STATES, MOVES = 180_000, 400_000
PAIRS = 150_000
PIECES = 250_000


def merge_encode(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the pair of lowest rank, leftmost first, until none is left. For short inputs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        low, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if low == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: What is pending after the last final token: that token (-1 at the start), how many bytes, the node of the bytes
#: since (-1 if no token begins so), and for each position in them that matters (position, where its last token
#: starts, that token, the node of the bytes after it).
State = tuple[int, int, int, tuple[tuple[int, int, int, int], ...]]
START: State = (-1, 0, 0, ())


class Transducer:
    """Reads bytes of a piece, emits ids. Nodes are those of the trie of all tokens, the root is 0."""

    def __init__(self, rank: dict[bytes, int], tables: float = 1.0) -> None:
        """tables: the share of STATES, MOVES and PAIRS that are kept."""
        self.rank, self.tables = rank, tables
        self.bytes = {i: t for t, i in rank.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token, self.inner = [-1], [True]  # of each node: its token, if any, and whether longer tokens begin so
        for t, i in rank.items():
            node = 0
            for byte in t:
                self.inner[node] = True
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = i
        self.code = {t: i.to_bytes(4, "little") for t, i in rank.items()}
        self.four = {i: self.code[t] for t, i in rank.items()}
        self.forget()

    def forget(self) -> None:
        """Drops all that was learnt from texts."""
        self.pairs: dict[int, bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self._forget()

    def _forget(self) -> None:
        """No states but the first, number 0, and no transitions."""
        self.states, self.number = [START], {START: 0}
        self.moves: dict[int, int] = {}  # number * 256 + byte -> number, or its complement if ids come out
        self.outs: dict[int, bytes] = {}  # number * 256 + byte -> those ids

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge gives token; None for a byte, and for a token that its own bytes don't merge to."""
        if token not in self.halves:
            parts = merge_encode(token, {k: v for i in range(len(token)) for j in range(i + 2, len(token) + 1) if (k := token[i:j]) != token and (v := self.rank.get(k)) is not None})
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts along one side of a token's merges, each with the rank of the merge that uses it up."""
        key = (token, side)
        out = self.spines.get(key)
        if out is None:
            out, part, used = [], token, 1 << 60
            while True:
                out.append((part, used))
                halves = self._halves(part)
                if halves is None:
                    break
                used, part = self.rank[part], halves[side]
            self.spines[key] = out
        return out

    def _fits(self, last: int, token: int) -> bool:
        """Whether token may follow last: no merge across their border comes before the merges that use up its two sides."""
        key = last << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS * self.tables:
                self.pairs.clear()
            found = self.pairs[key] = self._may_follow(last, self.bytes[token])
        return found

    def _may_follow(self, last: int, token: bytes) -> bool:
        if len(token) > 1 and self._halves(token) is None:
            return False
        if last < 0:
            return True
        rank, right = self.rank, self._spine(token, 0)
        for x, used in self._spine(self.bytes[last], 1):
            for y, used_too in right:
                m = rank.get(x + y)
                if m is not None and m < used and m <= used_too:
                    return False
        return True

    def _step(self, state: State, byte: int) -> tuple[State, bytes]:
        """The next state and the ids that become final."""
        base, n, first, known = state
        child, token_of, inner, fits = self.child, self.token, self.inner, self._fits
        n += 1
        new, live, moved = -1, 0, []
        if first >= 0:
            first = child.get(first << 8 | byte, -1)
            if first >= 0:
                token = token_of[first]
                if token >= 0 and fits(base, token):
                    new, start = token, 0
                if inner[first]:
                    live, low = 1, 0
                else:
                    first = -1
        for entry in known:  # in order: the longest last token is tried first
            p, s, last, node = entry
            if node < 0:
                moved.append(entry)
                continue
            node = child.get(node << 8 | byte, -1)
            if node >= 0:
                if new < 0:
                    token = token_of[node]
                    if token >= 0 and fits(last, token):
                        new, start = token, p
                if inner[node]:
                    if not live:
                        low = p
                    live += 1
                else:
                    node = -1
            moved.append((p, s, last, node))
        if new >= 0:
            moved.append((n, start, new, 0))
            if not live:
                low = n
            live += 1
        # From the last position back: what live positions descend from, until all descend from one.
        kept, cut = [], 0
        if live == 1:
            cut = low
        elif first < 0:
            wanted: set[int] = set()
            for entry in reversed(moved):
                p = entry[0]
                if entry[3] >= 0 or p in wanted:
                    wanted.discard(p)
                    live -= entry[3] >= 0
                    if not live and not wanted:
                        cut = p
                        break
                    wanted.add(entry[1])
                    kept.append(entry)
        else:
            wanted = set()
            for entry in reversed(moved):
                if entry[3] >= 0 or entry[0] in wanted:
                    wanted.add(entry[1])
                    kept.append(entry)
        if not cut:
            return (base, n, first, tuple(kept[::-1])), b""
        out, end, node, p = [], -1, -1, cut
        for place, s, token, at in reversed(moved):
            if place == p:
                if end < 0:
                    end, node = token, at
                out.append(token)
                p = s
        rest = tuple([(p - cut, s - cut, token, at) for p, s, token, at in reversed(kept)])
        return (end, n - cut, node, rest), b"".join([self.four[x] for x in reversed(out)])

    def _move(self, number: int, byte: int) -> tuple[int, bytes]:
        """A new transition, kept."""
        state, out = self._step(self.states[number], byte)
        if len(self.states) > STATES * self.tables or len(self.moves) > MOVES * self.tables:
            self._forget()
            number = -1  # where the transition began is forgotten too
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        if number >= 0:
            self.moves[number << 8 | byte] = ~to if out else to
            if out:
                self.outs[number << 8 | byte] = out
        return to, out

    def _end(self, state: State, byte: int) -> bytes:
        """The ids still pending when the piece ends with byte."""
        base, _, first, known = state
        child, token_of, fits = self.child, self.token, self._fits
        node = child.get(first << 8 | byte, -1) if first >= 0 else -1
        if node >= 0 and token_of[node] >= 0 and fits(base, token_of[node]):
            return self.four[token_of[node]]
        for p, _, last, node in known:
            if node >= 0:
                node = child.get(node << 8 | byte, -1)
                if node >= 0 and token_of[node] >= 0 and fits(last, token_of[node]):
                    break
        out = [self.four[token_of[node]]]
        for place, start, token, _ in reversed(known):
            if place == p:
                out.append(self.four[token])
                p = start
        return b"".join(out[::-1])

    def encode(self, piece: bytes) -> bytes:
        """Ids as little-endian 32-bit integers."""
        whole = self.code.get(piece)
        if whole is not None:
            return whole
        at, out, moves = 0, [], self.moves
        for byte in piece[:-1]:
            key = at << 8 | byte
            at = moves.get(key)
            if at is None:
                at, ids = self._move(key >> 8, byte)
                moves = self.moves
                out.append(ids)
            elif at < 0:
                at = ~at
                out.append(self.outs[key])
        # the state after the last byte isn't kept, for whole pieces are kept elsewhere
        out.append(self._end(self.states[at], piece[-1]))
        return b"".join(out)


class _Pieces(dict):
    """Ids of pieces met, as little-endian 32-bit integers; pieces met again outlive a change of generation."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer, self.old = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.transducer.encode(piece.encode())
        if len(piece) < 64:
            if len(self) > PIECES * self.transducer.tables:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Utf8Stream:
    """Text from bytes that arrive in any portions.

    What is between portions is the state of the automaton of Unicode's table of
    well-formed byte sequences: the bytes held of an unfinished character, how
    many are due, and the range of the next one. Ill-formed parts become U+FFFD,
    one for each maximal subpart.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    @staticmethod
    def first(byte: int) -> tuple[int, int, int] | None:
        """Bytes due after a leading byte and the range of the next one; None if no character starts so."""
        if byte < 0x80:
            return 0, 0x80, 0xBF
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None

    def _enter(self, data: bytes) -> bool:
        """Whether data begins a character and leaves it unfinished; the state is then what it leaves."""
        got = self.first(data[0])
        if got is None:
            return False
        due, low, high = got
        for byte in data[1:]:
            if not due or not low <= byte <= high:
                return False
            due, low, high = due - 1, 0x80, 0xBF
        self.due, self.low, self.high, self.held = due, low, high, data
        return due > 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        self.due, self.held = 0, b""
        # only one of the last three bytes can begin what is left unfinished
        for at in range(len(data) - 1, max(len(data) - 4, -1), -1):
            if data[at] >= 0xC0:
                if self._enter(data[at:]):
                    return data[:at].decode("utf-8", "replace")
                break
        self.due, self.held = 0, b""
        return data.decode("utf-8", "replace")

    def end(self) -> str:
        """What an unfinished character at the end becomes."""
        left, self.due, self.held = "\ufffd" * bool(self.due), 0, b""
        return left


class Codec:
    """Encoding and decoding for one vocabulary, with tables that persist in a Python worker."""

    def __init__(self, spec: Spec, tables: float = 1.0) -> None:
        rank = ranks(spec.path)
        self.pieces, self.split = _Pieces(Transducer(rank, tables)), regex.compile(spec.pattern).findall
        self.tokens = {i: t for t, i in rank.items()}
        top = max(self.tokens) + 1
        sizes = np.zeros(top + 1, np.int64)
        for i, t in self.tokens.items():
            sizes[i + 1] = len(t)
        self.at = np.cumsum(sizes)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8)

    def forget(self) -> None:
        """Drops what was learnt from texts, so that an idle Python worker holds the vocabulary alone."""
        self.pieces.transducer.forget()
        self.pieces.clear()
        self.pieces.old = {}
        gc.collect()
        _worker.give_back()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        return b"".join([pieces[x] for x in self.split(text)])

    def decode_bytes(self, ids: bytes) -> bytes:
        x = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(x):
            return b""
        if x.max() >= len(self.at) - 1 or (size := self.at[x + 1] - self.at[x]).min() == 0:
            raise KeyError("an id is not in the vocabulary")
        start = self.at[x] - (np.cumsum(size) - size)
        return self.bytes[np.repeat(start, size) + np.arange(size.sum())].tobytes()

    def decode_portions(self, ids: bytes, portion: int = 1 << 14) -> Iterator[bytes]:
        """UTF-8 text as far as it is complete after each portion of ids, by the incremental machine."""
        stream = Utf8Stream()
        for a in range(0, len(ids), 4 * portion):
            yield stream.feed(self.decode_bytes(ids[a : a + 4 * portion])).encode()
        yield stream.end().encode()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as far as it is complete after each id."""
        stream = Utf8Stream()
        for i in ids:
            yield stream.feed(self.tokens[i])
        yield stream.end()


@functools.lru_cache(maxsize=2)
def codec(spec: Spec, tables: float = 1.0) -> Codec:
    """The codec of this Python worker; tasks share the vocabulary. Its tables are many small objects without cycles, so the collector looks at them less often."""
    gc.set_threshold(50_000, 50, 50)
    return Codec(spec, tables)


def _encoded(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    own = codec(spec)
    try:
        for batch in batches:
            _, offsets = _text.utf8(batch.column(1))
            for a, b in _text.chunks(offsets):
                part = batch.slice(a, b - a)
                ids = [own.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], ["key", "ids"])
    finally:
        own.forget()


def encode(docs: DataFrame, spec: Spec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and ids: its tokens as little-endian unsigned 32-bit integers."""
    spec = spec or default_spec()
    _spark.with_small_batches(docs.sparkSession)
    source = docs.select(_spark.id_or_min(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(lambda it: _encoded(it, spec), "key long, ids binary")
    return out.select(_spark.id_back("key").alias(id_col), "ids")


def _decoded(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    own = codec(spec)
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            text = [b"".join(own.decode_portions(x.as_py() or b"")).decode() for x in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(text, pa.string())], ["key", "text"])


def decode(encoded: DataFrame, spec: Spec | None = None, id_col: str = "doc_id") -> DataFrame:
    """The inverse of encode: each row's id and text; bytes that are no UTF-8 become U+FFFD."""
    spec = spec or default_spec()
    source = encoded.select(_spark.id_or_min(id_col).alias("key"), F.col("ids"))
    out = source.mapInArrow(lambda it: _decoded(it, spec), "key long, text string")
    return out.select(_spark.id_back("key").alias(id_col), "text")


def _digests(batches: Iterator[pa.RecordBatch], spec: Spec, with_ids: bool, tables: float, keep: bool) -> Iterator[pa.RecordBatch]:
    own = codec(spec, tables)
    rows, size = [], 0
    try:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, decoded = own.encode(text.as_py() or ""), hashlib.sha256()
                for x in own.decode_portions(ids):
                    decoded.update(x)
                rows.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), ids if with_ids else b""))
                size += 200 + len(rows[-1][-1])
                if size > _text.CHUNK:
                    yield _as_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _as_batch(rows)
    finally:
        if not keep:
            own.forget()


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()))
    return pa.record_batch([pa.array([x[i] for x in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def round_trip(docs: DataFrame, spec: Spec | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", tables: float = 1.0, keep: bool = False) -> DataFrame:
    """Each row's id, n_tokens, ids_sha256, decoded_sha256 and ids, encoded and decoded in one pass so that ids needn't be moved.

    tables: the share of the usual table sizes that a worker keeps, about 230 MB at 1; with less of them more is worked out again.
    keep: the tables stay in the worker for the tasks that follow, for jobs in which nothing else needs the memory.
    """
    spec = spec or default_spec()
    _spark.with_small_batches(docs.sparkSession)
    source = docs.select(_spark.id_or_min(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(lambda it: _digests(it, spec, with_ids, tables, keep), "key long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return out.select(_spark.id_back("key").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
