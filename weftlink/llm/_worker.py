"""What Python workers do besides their work."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system: a worker that idles between stages would hold it beside those that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def task(f: Callable) -> Callable:
    """f, a generator over batches, gives its memory back at its end."""

    @functools.wraps(f)
    def run(*args, **kwargs):  # noqa: ANN002, ANN003, ANN202
        try:
            yield from f(*args, **kwargs)
        finally:
            give_back()

    return run


def group(f: Callable) -> Callable:
    """f, a function of one group's table, gives its memory back at its end."""

    @functools.wraps(f)
    def run(*args, **kwargs):  # noqa: ANN002, ANN003, ANN202
        try:
            return f(*args, **kwargs)
        finally:
            give_back()

    return run
