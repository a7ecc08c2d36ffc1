"""Arrow batches in Python workers: slices of bounded size, and memory given back."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 2 << 20
#: Rows handled at once, however short.
SLICE_ROWS = 1 << 17


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text and ``rows`` rows each, in order."""
    n = len(texts)
    if n == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))), start + rows)
        yield start, stop
        start = stop


def trim() -> None:
    """Gives memory that a worker has freed back to the system; called where a task's heavy work
    ends, because workers live on and the next stage runs beside what they keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """A task's function over batches that ends with ``trim``."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task
