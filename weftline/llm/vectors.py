"""Vectors as rows of a matrix: reading list columns of Arrow batches with nulls and unequal lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest, float64, zeros where a row is shorter; whether each row is a vector of finite components).

    Null vectors and those that hold null or non-finite components are not; an empty one is.
    """
    n = len(column)
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    good = np.ones(n, bool)
    if column.null_count:
        good &= np.asarray(column.is_valid())
        column = column.fill_null(pa.scalar([], column.type))
    if not n:
        return np.zeros((0, 0)), good
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = column.flatten()
    offsets = offsets - offsets[0]
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.zeros(0)
    sizes = np.diff(offsets)
    width = int(sizes.max())
    if (sizes == width).all():
        out = values.reshape(n, width).copy()
    else:
        out = np.zeros((n, width))
        row = np.repeat(np.arange(n), sizes)
        out[row, np.arange(len(values)) - offsets[row]] = values
    finite = np.isfinite(out).all(1)
    out[~finite] = 0.0
    return out, good & finite


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a numeric matrix as bytes, without zeros at its end."""
    ends = rows.shape[1] - (rows[:, ::-1] != 0).argmax(1) if rows.shape[1] else np.zeros(len(rows), np.int64)
    ends = np.where((rows != 0).any(1), ends, 0) if rows.shape[1] else ends
    size = rows.dtype.itemsize
    raw = np.ascontiguousarray(rows).tobytes()
    step = rows.shape[1] * size
    return pa.array([raw[i * step : i * step + int(e) * size] for i, e in enumerate(ends)], pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dtype: str = "<f8") -> np.ndarray:
    """The matrix of ``packed`` rows, as wide as the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    raws = column.to_pylist()
    size = np.dtype(dtype).itemsize
    width = max((len(r) for r in raws), default=0) // size
    if all(len(r) == width * size for r in raws):
        return np.frombuffer(b"".join(raws), dtype).reshape(len(raws), width)
    out = np.zeros((len(raws), width), dtype)
    for i, r in enumerate(raws):
        out[i, : len(r) // size] = np.frombuffer(r, dtype)
    return out
