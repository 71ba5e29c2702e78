"""Vectors of Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values (double, null: NaN), and the first value and length of every row (null row: length 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    present = ~column.is_null().to_numpy(zero_copy_only=False)
    return flat, offsets[:-1], np.where(present, np.diff(offsets), 0)


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every length of 1 or more; rows with null or non-finite components are left out."""
    flat, first, length = parts(column)
    out = []
    for n in np.unique(length[length > 0]):
        at = np.flatnonzero(length == n)
        matrix = flat[first[at][:, None] + np.arange(n)]
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            out.append((at[fine], matrix[fine]))
    return out


def packed(matrix: np.ndarray) -> list[bytes]:
    """Every row's bytes."""
    data, width = np.ascontiguousarray(matrix).tobytes(), matrix.shape[1] * matrix.itemsize
    return [data[k:k + width] for k in range(0, len(data), width)]


def unpacked(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """The matrix of rows packed with one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)
