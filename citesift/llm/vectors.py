"""Vector columns as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values as double, begin and end of each row's vector; null rows and rows that hold null or
    non-finite components have an empty range and ``begin`` -1."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        z = np.zeros(0, np.int64)
        return np.zeros(0), z, z
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(col)
    values = pc.fill_null(pc.cast(flat, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    end = np.cumsum(lengths)
    begin = end - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[end] == bad[begin]) & ~pc.is_null(col).to_numpy(zero_copy_only=False)
    return values, np.where(good, begin, -1), np.where(good, end, -1)


def pack(rows: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([r.astype(kind).tobytes() for r in rows], pa.binary())


def unpack(col, kind: str) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    data = b"".join(col.to_pylist())
    n = len(col)
    return np.frombuffer(data, dtype=kind).reshape(n, -1).astype(np.float64) if n and data else np.zeros((n, 0))
