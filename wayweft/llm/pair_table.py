"""Open addressing from a pair of small integers to an integer, in numpy."""

from __future__ import annotations

import numpy as np

NONE = np.int32(np.iinfo(np.int32).max)


class PairTable:
    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        left, right, value = (np.asarray(x, dtype=np.int64) for x in (left, right, value))
        self.bits = max(4, int(2 * max(len(value), 1)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys, waiting = self._key(left, right), np.arange(len(value))
        at, self.probes = self._slot(keys), 0
        while len(waiting):
            self.probes += 1
            free = waiting[self.keys[at[waiting]] == -1]
            _, first = np.unique(at[free], return_index=True)  # one of those that want the same free slot
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], value[put]
            waiting = np.setdiff1d(waiting, put, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values; NONE where the table has no such pair (it never has a negative number)."""
        keys = self._key(left, right)
        out = np.full(keys.shape, NONE, dtype=np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys[live]
        at = self._slot(keys)
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys
            out[live[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            if not on.any():
                break
            live, keys, at = live[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out
