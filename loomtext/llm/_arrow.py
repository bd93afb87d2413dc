"""Small helpers for ``mapInArrow``."""

from __future__ import annotations

import ctypes
import time

import numpy as np
import pyarrow as pa


def rows(batch: pa.RecordBatch, *names: str):
    """Iterate over the named columns of a batch as Python values, one row at a time."""
    return zip(*(map(_value, batch.column(name)) for name in names))


def _value(x):
    return x.as_py()


_trimmed = 0.0


def trim(pause: float = 0.0) -> None:
    """Give freed memory back to the system, which a worker would else keep while it waits or does other work.

    Getting it again costs time: not done within ``pause`` seconds of the last time.
    """
    global _trimmed
    if pause and time.monotonic() - _trimmed < pause:
        return
    _trimmed = time.monotonic()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if give_back:
        give_back(0)


def lists(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """A list column from one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(kind) if flat.dtype != kind else flat))
