"""Where the byte-level BPE vocabulary and its splitting pattern come from; both can be given by the caller."""

from __future__ import annotations

import base64
import functools
from dataclasses import dataclass


@dataclass(frozen=True)
class Spec:
    """A rank file (base64 token, rank) as a path that exists on every executor, and the splitting pattern."""

    path: str
    pattern: str


def default_spec(name: str = "byte_bpe_50k.tiktoken") -> Spec:
    import public_tokenizers

    return Spec(public_tokenizers.path(name), public_tokenizers.PATTERN)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@functools.lru_cache(maxsize=4)
def library_encoding(spec: Spec):  # noqa: ANN201
    import tiktoken

    return tiktoken.Encoding("own", pat_str=spec.pattern, mergeable_ranks=ranks(spec.path), special_tokens={})
