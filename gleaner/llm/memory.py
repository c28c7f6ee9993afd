"""Memory of Python workers, which Spark keeps and hands from task to task."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Hand freed memory back to the system instead of holding it for later allocations."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function over batches after which, and every 64 MB on the way, the worker gives freed memory back."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in batches:
                seen += batch.nbytes
                if seen > 64 << 20:
                    seen = 0
                    give_back()
                yield batch
        yield from run(counted())
        give_back()
    return wrapped
