"""Vectors in Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are whole (not null, no null or non-finite component), and those rows as float64, zeros up to ``width``."""
    if not pa.types.is_float64(column.type.value_type):
        column = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    finite = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ok = (sizes > 0) & (np.bincount(owner[~finite], minlength=len(sizes)) == 0)
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    ends = np.cumsum(sizes)
    out[owner, np.arange(len(values)) - (ends - sizes)[owner]] = values
    return ok, out[ok]


def pack(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows)]


def unpack(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), dtype=dtype)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.buffers()[1]
    first = np.frombuffer(offsets, dtype="<i4", count=column.offset + 1)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=dtype, offset=int(first), count=len(column) * width).reshape(len(column), width)
