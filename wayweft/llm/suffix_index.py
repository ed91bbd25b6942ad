"""A logarithmic family of suffix arrays over passages of bytes, which tells what windows of a given length recur.

A batch of passages gets a suffix array (windows in the order of their bytes, by doubled ranks). It is merge-scanned
against every level of the family, which tells where each of its windows stands there, and which of them are there
already. A window enters the family once; level k holds the windows of 2**k batches, and two levels of a size merge into
the next. What stands in a level was scanned against all higher ones when it came, so merging needs no comparison.
"""

from __future__ import annotations

import dataclasses

import numpy as np

#: Bytes of a batch: a position has BITS bits in the sorted keys.
BITS = 20
BATCH = (1 << BITS) - 64

_U = np.uint64


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one big-endian number; data ends with eight bytes of padding."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def suffix_array(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows in the order of their bytes, and for each whether it differs from the one before it.

    data: passages one after another and eight bytes of padding, BATCH at most; ends: the end of each place's passage."""
    mask = _U((1 << BITS) - 1)

    def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys.sort()
        at = (keys & mask).astype(np.int64)
        keys >>= _U(BITS)
        return at, np.concatenate([[True], keys[1:] != keys[:-1]])

    depth = min(5, window)
    places = np.flatnonzero(np.arange(len(ends)) + depth <= ends)
    codes = words(data)[places].astype(_U) >> _U(64 - 8 * depth)
    at, new = ranked((codes << _U(BITS)) | places.astype(_U))
    rank = np.zeros(len(ends), _U)
    while depth < window and len(places):
        rank[at] = (np.cumsum(new) - 1).astype(_U)
        step = min(depth, window - depth)  # the last step overlaps
        places = places[places + depth + step <= ends[places]]
        at, new = ranked((rank[places] << _U(2 * BITS)) | (rank[places + step] << _U(BITS)) | places.astype(_U))
        depth += step
    return at, new[: len(at)]


@dataclasses.dataclass
class Level:
    """Windows in order, their first words, and where each belongs in the higher levels."""

    at: np.ndarray
    heads: np.ndarray
    places: dict[int, np.ndarray]


def _interleaved(old: np.ndarray, new: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.empty(len(old) + len(new), old.dtype)
    fresh = np.zeros(len(out), dtype=bool)
    fresh[where] = True
    out[fresh], out[~fresh] = new, old
    return out


class Family:
    """Passages in the order of their arrival, and for each of their places whether the window there recurs."""

    def __init__(self, window: int):
        if window < 8:
            raise ValueError("windows have at least eight bytes")
        self.window = window
        self.offsets = np.array([*range(0, window - 7, 8), *([window - 8] if window % 8 else [])])
        self.data, self.again = np.zeros(8, np.uint8), np.zeros(8, dtype=bool)
        self.starts: list[np.ndarray] = []
        self.levels: list[Level | None] = []

    def add(self, passages: list[bytes], recurs: list[bool]) -> None:
        """A batch. recurs: passages that occur several times, so that all their windows recur."""
        sizes = np.array([len(p) for p in passages], np.int64)
        base, stops = len(self.data) - 8, np.cumsum(sizes)
        batch = np.frombuffer(b"".join(passages) + bytes(8), np.uint8)
        self.starts.append(base + stops - sizes)
        self.data = np.concatenate([self.data[:-8], batch])
        self.words = words(self.data)
        self.again = np.concatenate([self.again[:-8], np.repeat(np.array(recurs, dtype=bool), sizes), np.zeros(8, dtype=bool)])
        at, new = suffix_array(batch, np.repeat(stops, sizes), self.window)
        kind = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        several = np.diff(np.append(first, len(at))) > 1
        at = at + base
        fresh = at[first]
        places, known = {}, np.zeros(len(fresh), dtype=bool)
        for k, level in enumerate(self.levels):
            if level is not None:
                places[k], here = self._scan(level, fresh)
                self.again[level.at[places[k][here]]] = True
                known |= here
        self.again[at[(several | known)[kind]]] = True
        stay = ~known  # a window of a higher level needs no second entry
        fresh = fresh[stay]
        carry = Level(fresh, self.words[fresh].astype(_U), {k: x[stay] for k, x in places.items()})
        k = 0
        while k < len(self.levels) and (level := self.levels[k]) is not None:
            where = carry.places.pop(k) + np.arange(len(carry.at))
            carry = Level(_interleaved(level.at, carry.at, where), _interleaved(level.heads, carry.heads, where), {j: _interleaved(level.places[j], x, where) for j, x in carry.places.items()})
            self.levels[k] = None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = carry

    def _scan(self, level: Level, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows belong in a level's order, and which of them are there."""
        heads = self.words[fresh].astype(_U)
        low, high = (np.searchsorted(level.heads, heads, side) for side in ("left", "right"))
        wide = np.flatnonzero(high - low > 1)
        for offset in self.offsets[1:]:  # word by word, while several windows of the level agree so far
            if not len(wide):
                break
            target = self.words[fresh[wide] + offset].astype(_U)
            for side, bound in ((0, low), (1, high)):
                left, right = low[wide], high[wide]
                while len(open_ := np.flatnonzero(left < right)):
                    middle = (left[open_] + right[open_]) >> 1
                    word = self.words[level.at[middle] + offset].astype(_U)
                    up = word <= target[open_] if side else word < target[open_]
                    left[open_[up]], right[open_[~up]] = middle[up] + 1, middle[~up]
                bound[wide] = left
            wide = wide[high[wide] - low[wide] > 1]
        same = np.zeros(len(fresh), dtype=bool)
        one = np.flatnonzero(high > low)
        for i in range(0, len(one), 4096):  # what is left agrees so far with one window of the level
            some = one[i : i + 4096]
            own, theirs = (self.words[x[:, None] + self.offsets] for x in (fresh[some], level.at[low[some]]))
            differ = own != theirs
            where = differ.argmax(axis=1)
            rows = np.arange(len(some))
            same[some] = ~differ[rows, where]
            low[some] += differ[rows, where] & (own[rows, where] > theirs[rows, where])
        return low, same

    def spans(self) -> list[tuple[int, int, int]]:
        """(passage, start, end) of what recurring windows cover, merged within each passage."""
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0, np.int64)
        # in a passage that occurs several times, places less than a window from the end start none
        at = np.flatnonzero(self.again[: len(self.data) - 8])
        passage = np.searchsorted(starts, at, side="right") - 1
        ends = np.append(starts[1:], len(self.data) - 8)
        fits = at + self.window <= ends[passage]
        at, passage = at[fits], passage[fits]
        first = np.flatnonzero(np.concatenate([[True], (passage[1:] != passage[:-1]) | (at[1:] > at[:-1] + self.window)])) if len(at) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        own = starts[passage[first]]
        return list(zip(passage[first].tolist(), (at[first] - own).tolist(), (at[last] + self.window - own).tolist()))
