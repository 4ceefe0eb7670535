"""Arrow columns made from their buffers.

``pa.array`` loads pandas when it is there, which makes a Python worker half as large again; these don't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def numbers(values: np.ndarray) -> pa.Array:
    """A column of numpy's numbers, without nulls."""
    return pa.Array.from_buffers(pa.from_numpy_dtype(values.dtype), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))])


def _held(data: bytes | np.ndarray) -> pa.Buffer:
    """A copy in Arrow's own memory."""
    data = np.frombuffer(data, np.uint8)
    out = pa.allocate_buffer(len(data))
    np.frombuffer(out, np.uint8)[:] = data
    return out


def _ends(sizes: list[int]) -> pa.Buffer:
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("a column of texts can't hold more than 2^31 bytes")
    return _held(ends.astype(np.int32))


def texts(values: list[str]) -> pa.Array:
    """A column of texts, without nulls."""
    parts = [v.encode() for v in values]
    return pa.StringArray.from_buffers(len(parts), _ends([len(p) for p in parts]), _held(b"".join(parts)))


def text_lists(rows: list[list[str] | None]) -> pa.Array:
    """A column of lists of texts; a row may be null."""
    there = _held(np.packbits([r is not None for r in rows], bitorder="little")) if None in rows else None
    inner = texts([v for r in rows for v in r or ()])
    return pa.Array.from_buffers(pa.list_(pa.string()), len(rows), [there, _ends([len(r or ()) for r in rows])], children=[inner])
