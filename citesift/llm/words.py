"""Vectorised word work on Arrow text columns: word bounds, word hashes, hashes of word runs.

A word is a maximal run of bytes other than ``0x20`` and ``0x09``-``0x0D``.  UTF-8 never uses those bytes
inside a longer character, so cutting the bytes is cutting the text.  All functions work on one block of
texts at a time; :func:`blocks` cuts a record batch into blocks of bounded bytes, so memory follows the
block size (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
# odd multipliers: odd numbers have an inverse modulo 2**64, which lets a prefix sum give any run's hash
_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F, 2: 0xD6E8FEB86659FD93, 3: 0xA0761D6478BD642F}
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = _BASES[which]
        if inverse:
            base = pow(base, -1, 1 << 64)
        size = -(-max(n, 1) // 65536) * 65536
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[(which, inverse)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that every output bit depends on every input bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (``n + 1``) of a string column; a null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind, count=len(col) + 1, offset=col.offset * np.dtype(kind).itemsize)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` whose texts hold at most ``limit`` bytes (a longer text comes alone)."""
    raw, offs = text_buffer(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        # many empty texts share one offset: a row bound keeps a block small in rows as well
        j = min(j, i + 65536)
        yield batch.slice(i, j - i), raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (``n + 1`` values)."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~_SPACE[raw]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    inner = offs[:-1][offs[:-1] < n]
    first[inner] = True
    first &= ink
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(ink[1:], out=last[:-1])
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = True
    last &= ink
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def run_hashes(values: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive values; position ``i`` is the run that starts there."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(which, len(values), False), out=total[1:])
    return mix((total[length:] - total[:n]) * _powers(which, n, True))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * _powers(which, len(raw), False), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(which, len(raw) + 1, True)[starts])


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values (doubling, no per-window loop)."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def inside(first: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """For each run start ``0 .. n_words - length``: does the run stay inside one text?"""
    n = n_words - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, dtype=bool)
    # a run that starts within the last ``length - 1`` words of a text crosses into the next one
    for back in range(1, length):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok
