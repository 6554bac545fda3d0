"""Integer arrays as compressed byte planes, for shuffles of whole blocks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    codec = pa.Codec("zstd", compression_level=1)
    out = [struct.pack("<B", len(arrays))]
    for x in arrays:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
        body = codec.compress(raw, asbytes=True)
        out.append(struct.pack("<2sQQ", x.dtype.str[1:].encode(), len(x), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    codec, at, out = pa.Codec("zstd"), 1, []
    for _ in range(data[0]):
        kind, n, size = struct.unpack_from("<2sQQ", data, at)
        at += struct.calcsize("<2sQQ")
        dtype = np.dtype("<" + kind.decode())
        raw = codec.decompress(data[at : at + size], n * dtype.itemsize, asbytes=True)
        out.append(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n))
        at += size
    return out
