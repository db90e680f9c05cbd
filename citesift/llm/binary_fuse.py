"""Static binary-fuse filters: 3-wise, 8-bit fingerprints, about nine bits a key, no false negatives.

A key has one slot in each of three neighbouring segments and its fingerprint is the XOR of the three cells.
Cells are found by peeling: a key that is alone in a slot is put aside, which leaves others alone.  All keys that
are alone at once are peeled together, and filled in the opposite order, as array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_M = _U(0xFFFFFFFF)


def _scramble(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + _U(seed)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class Fuse:
    """``cells`` over segments of ``2**bits`` slots, of which a key's first slot may be in the first ``starts`` segments."""

    seed: int
    bits: int
    starts: int
    cells: np.ndarray

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        size = 1 << self.bits
        first = ((h >> _U(32)) * _U(self.starts * size)) >> _U(32)
        mask = _U(size - 1)
        second = (first + _U(size)) ^ ((h >> _U(18)) & mask)
        third = (first + _U(2 * size)) ^ (h & mask)
        return [x.astype(np.int64) for x in (first, second, third)]

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key the filter was built from, and for about one other key in 256."""
        if not len(self.cells):
            return np.zeros(len(keys), bool)
        h = _scramble(keys.astype(_U, copy=False), self.seed)
        a, b, c = self._slots(h)
        return self._prints(h) == self.cells[a] ^ self.cells[b] ^ self.cells[c]


def build(keys: np.ndarray) -> Fuse:
    """The filter of a set of 64-bit keys (repeats count once; no keys: a filter that holds nothing)."""
    keys = np.unique(keys.astype(_U, copy=False))
    n = len(keys)
    if not n:
        return Fuse(0, 0, 0, np.zeros(0, np.uint8))
    bits = max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 4
    starts = max(1, int(np.ceil(room / (1 << bits))) - 2)
    for seed in range(1, 1000):
        # a graph that does not peel is drawn anew, with a little more room every few times
        out = Fuse(seed, bits, starts + seed // 8, np.zeros((starts + seed // 8 + 2) << bits, np.uint8))
        if _fill(out, keys):
            return out
    raise RuntimeError(f"no filter for {n} keys")


def _fill(out: Fuse, keys: np.ndarray) -> bool:
    h = _scramble(keys, out.seed)
    slots = np.stack(out._slots(h))
    count = np.zeros(len(out.cells), np.int32)
    which = np.zeros(len(out.cells), np.int64)
    number = np.arange(len(keys))
    for s in slots:
        np.add.at(count, s, 1)
        np.bitwise_xor.at(which, s, number)
    peeled: list[tuple[np.ndarray, np.ndarray]] = []
    alone = np.flatnonzero(count == 1)
    left = len(keys)
    while len(alone):
        key, at = np.unique(which[alone], return_index=True)
        peeled.append((key, alone[at]))
        left -= len(key)
        touched = slots[:, key]
        for s in touched:
            np.subtract.at(count, s, 1)
            np.bitwise_xor.at(which, s, key)
        near = np.unique(touched)
        alone = near[count[near] == 1]
    if left:
        return False
    prints = out._prints(h)
    for key, at in reversed(peeled):
        a, b, c = slots[:, key]
        # the slot a key was alone in is still empty, so it does not matter that it is among the three
        out.cells[at] = prints[key] ^ out.cells[a] ^ out.cells[b] ^ out.cells[c]
    return True
