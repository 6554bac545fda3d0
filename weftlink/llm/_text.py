"""Vectorised access to the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``. The
separators are ASCII, so working on UTF-8 bytes gives the same words as working
on characters. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that a step of vectorised work takes at once; a longer document is taken alone.
CHUNK = 1 << 20
#: Bytes hashed at once.
_SLICE = 1 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & (2**64 - 1), _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_WORDS = _Powers(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh uint64 array."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Random numbers for each of the first places of a span and each byte.
_PLACES = 64
_AT_PLACE = mix(np.arange(1, _PLACES * 256 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the len+1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes each, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_spans(body: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in body, and the len+1 word offsets of the rows. separators: a flag for each byte."""
    inside = ~separators[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(body))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap.

    It mixes the sum of a random number for each (place in the span, byte). Unlike
    a polynomial modulo 2**64, that has no texts that collide by their structure.
    """
    out = np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        n = int(ends[b - 1] - base)
        s, e = starts[a:b] - base, ends[a:b] - base
        kind = np.int32 if n < 1 << 22 else np.int64
        origin = np.zeros(n, kind)
        origin[s[1:]] = np.diff(s)
        place = np.arange(n, dtype=kind) - np.cumsum(origin, dtype=kind)
        part = body[base : base + n]
        term = _AT_PLACE[np.minimum(place, _PLACES - 1) << 8 | part]
        far = np.flatnonzero(place >= _PLACES - 1)
        if len(far):
            term[far] = mix((place[far] << 8 | part[far]).astype(_U) * _U(0xD6E8FEB86659FD93))
        total = np.zeros(n + 1, _U)
        np.cumsum(term, out=total[1:])
        out[a:b] = total[e] - total[s] + (e - s).astype(_U) * _U(0xA0761D6478BD642F)
        a = b
    return mix(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of width hashes: a prefix sum of words times powers of a base, modulo 2**64."""
    n = len(words)
    if n < width:
        return np.zeros(0, _U)
    out = np.empty(n - width + 1, _U)
    step = 1 << 18
    up, down = _WORDS.get(min(n, step + width))
    for a in range(0, len(out), step):
        part = words[a : a + step + width - 1]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - width + 1
        out[a : a + m] = (total[width:] - total[:m]) * down[:m]
    return mix(out)


def doc_windows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows over all words: which lie in one document, as positions, and the document of each."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    shift = offsets[:-1] - (np.cumsum(counts) - counts)
    return np.arange(len(doc)) + shift[doc], doc
