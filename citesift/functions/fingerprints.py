"""Winnowed fingerprints of texts, as numpy kernels over Arrow string columns.

The hashes of all runs of ``k`` bytes pass under a sliding window of ``width`` of them and each window keeps its
smallest.  Two texts that share a passage of ``k + width - 1`` bytes or more share a whole window, and with it a
fingerprint, whatever stands around the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TOP = np.iinfo(np.uint64).max


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=_U)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out[:n]


def run_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` bytes: a prefix sum gives any run, an odd base can be divided out again."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * _powers(len(raw), _BASE), out=total[1:])
    h = (total[k:] - total[:n]) * _powers(n, pow(_BASE, -1, 1 << 64))
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return h ^ (h >> _U(27))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def fingerprints(raw: np.ndarray, offs: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and fingerprint, each pair once, for the texts at ``offs`` of ``raw``.  A text of fewer than
    ``k + width - 1`` bytes has none."""
    span = k + width - 1
    if len(raw) < span:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    low = window_min(run_hashes(raw, k), width)
    start = np.arange(len(low))
    text = np.searchsorted(offs, start, side="right") - 1
    good = start + span <= offs[text + 1]
    # a run of windows mostly keeps the same hash
    good[1:] &= (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
    text, low = text[good], low[good]
    order = np.lexsort((low, text))
    text, low = text[order], low[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1])
    return text[new], low[new]


def text_blocks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, UTF-8 bytes and offsets of runs of rows that hold at most ``limit`` bytes (a longer text comes alone)."""
    col = pc.fill_null(col, "")
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(offs, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = min(max(int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1, i + 1), len(col), i + 65536)
        yield i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
