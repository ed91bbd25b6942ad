"""The segments that can be nearest to points, found in blocks of points and segments over a fine grid."""

from __future__ import annotations

import numpy as np

#: Metres of both axes of the plane in which segments are told apart; what they are off by is allowed for.
PER_LON, PER_LAT = 111_320.0, 110_540.0
#: Segments of the first turn, and at most of one; each turn has this many times those of the one before. Pairs of one turn.
FIRST, MOST, GROWTH, PAIRS = 64, 1 << 11, 4, 1 << 20


def _spread(first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ranges and every number in first..past-1 of each."""
    n = np.maximum(past - first, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class _Cells:
    """Points in rows and columns of square cells, about one a cell, but no cells smaller than the reach."""

    def __init__(self, which: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float):
        self.west, self.south = x.min(), y.min()
        wide, high = x.max() - self.west, y.max() - self.south
        self.side = max(np.sqrt(wide * high / len(x)), max(wide, high) / 512, reach, 1e-3)
        self.reach = reach
        self.columns, self.rows = int(wide / self.side) + 1, int(high / self.side) + 1
        row, column = ((y - self.south) / self.side).astype(np.int64), ((x - self.west) / self.side).astype(np.int64)
        cell = row * self.columns + column
        self.points = which[np.argsort(cell, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=self.rows * self.columns))))

    def near(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, first and past: ranges of self.points, with all that are within reach of the segment."""
        side, reach = self.side, self.reach
        low, high = np.minimum(y1, y2), np.maximum(y1, y2)
        to_row = lambda y: np.clip(np.floor((y - self.south) / side), -1, self.rows).astype(np.int64)
        at, row = _spread(np.maximum(to_row(low - reach), 0), np.minimum(to_row(high + reach), self.rows - 1) + 1)
        bottom = self.south + row * side - reach
        rise = (y2 - y1)[at]
        slope = np.divide((x2 - x1)[at], rise, out=np.zeros(len(at)), where=rise != 0)
        level = rise == 0
        enter = x1[at] + slope * (np.clip(bottom, low[at], high[at]) - y1[at])
        leave = x1[at] + slope * (np.clip(bottom + side + 2 * reach, low[at], high[at]) - y1[at])
        west = np.where(level, np.minimum(x1, x2)[at], np.minimum(enter, leave)) - reach
        east = np.where(level, np.maximum(x1, x2)[at], np.maximum(enter, leave)) + reach
        to_column = lambda x: np.clip(np.floor((x - self.west) / side), -1, self.columns).astype(np.int64)
        one, two = np.maximum(to_column(west), 0), np.minimum(to_column(east), self.columns - 1)
        some = one <= two
        at, row, one, two = at[some], row[some] * self.columns, one[some], two[some]
        return at, self.starts[row + one], self.starts[row + two + 1]


def candidates(lon: np.ndarray, lat: np.ndarray, lines: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, segment) with all nearest segments of each point within the radius, and hardly any other.

    lines: rows x1, y1, x2, y2 in degrees. Segments are taken in turns. A point is as near to a segment as those seen so far
    are, at most, so where roads are dense it soon meets only the cells right beside the line; points that are still far
    from all lines have cells of their own.
    """
    if not len(lon) or not len(lines):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    squeeze = np.cos(np.radians(lat))
    least = max(float(squeeze.min()), 1e-9)  # of a metre of the grid along a parallel, for any point
    mid_lon, mid_lat = float(lon.mean()), float(lat.mean())
    x, y = (lon - mid_lon) * PER_LON, (lat - mid_lat) * PER_LAT
    ends = np.ascontiguousarray(((lines - np.array([mid_lon, mid_lat] * 2)) * np.array([PER_LON, PER_LAT] * 2)).T)
    # what rounding may move, in metres
    slack = 1e-6 + 1e-9 * radius
    best = np.full(len(x), radius + slack)
    order = np.random.default_rng(0).permutation(len(lines))  # roads in a row of the table are near each other
    found, at, turn = [], 0, FIRST
    while at < len(order):
        some, turn = order[at : at + turn], min(MOST, turn * GROWTH)
        bar = float(np.median(best)) * 2
        groups = [w for w in (np.flatnonzero(best <= bar), np.flatnonzero(best > bar)) if len(w)]
        cells = [_Cells(w, x[w], y[w], float(best[w].max()) / least) for w in groups]
        met = [c.near(*(e[some] for e in ends)) for c in cells]
        pairs = np.cumsum(sum(np.bincount(i, past - first, len(some)) for i, first, past in met))
        some = some[: max(1, int(np.searchsorted(pairs, PAIRS, side="right")))]
        at += len(some)
        x1, y1, x2, y2 = (e[some] for e in ends)
        s, p = [], []
        for c, (i, first, past) in zip(cells, met):
            taken = np.searchsorted(i, len(some))  # segments are in their order
            of, place = _spread(first[:taken], past[:taken])
            s.append(i[:taken][of])
            p.append(c.points[place])
        s, p = np.concatenate(s), np.concatenate(p)
        q = squeeze[p]
        ax, ay, dx, dy = (x1[s] - x[p]) * q, y1[s] - y[p], (x2 - x1)[s] * q, (y2 - y1)[s]
        length2 = dx * dx + dy * dy
        off = ax * dy - ay * dx
        near = off * off <= (best[p] + slack) ** 2 * length2 * (1 + 1e-9) + 1e-12  # the line is no farther than the segment
        s, p, ax, ay, dx, dy, length2 = (v[near] for v in (s, p, ax, ay, dx, dy, length2))
        t = np.clip(np.divide(-(ax * dx + ay * dy), length2, out=np.zeros(len(s)), where=length2 > 0), 0, 1)
        far = np.hypot(ax + t * dx, ay + t * dy)
        near = far <= best[p]
        s, p, far = s[near], p[near], far[near]
        np.minimum.at(best, p, far + slack)
        near = far <= best[p]
        found.append((p[near], some[s[near]], far[near]))
    p, s, far = (np.concatenate(f) for f in zip(*found))
    near = far <= best[p]
    return p[near], s[near]
