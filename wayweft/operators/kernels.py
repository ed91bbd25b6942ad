"""The few sequential kernels, as plain functions over one small group at a time."""

from __future__ import annotations

import math

import numpy as np

Line = list[tuple[float, float]]


def simplify(points: Line, tolerance: float) -> Line:
    """Douglas-Peucker: a stretch is dropped if all of it is within the tolerance of its chord."""
    xy = np.asarray(points, dtype=float)
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
        length2 = float(d @ d)
        t = np.clip(p @ d / length2, 0, 1) if length2 else np.zeros(len(p))
        away = np.hypot(*(p - t[:, None] * d).T)
        far = int(away.argmax())
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            stack += [(a, a + 1 + far), (a + 1 + far, b)]
    return [tuple(x) for x in xy[keep].tolist()]


#: Pairs of edges compared at once.
PAIRS = 1 << 20


def crosses_itself(ring: Line) -> bool:
    """Whether two edges that are no neighbours cross properly.

    A sweep along the axis on which fewer edges overlap: edges in the order of their lower ends, each with those that
    begin before it ends."""
    xy = np.asarray(ring, dtype=float)
    a, b = xy[:-1], xy[1:]
    m = len(a)
    low, high = np.minimum(a, b), np.maximum(a, b)
    best = None
    for axis in (0, 1):
        order = np.argsort(low[:, axis], kind="stable")
        until = np.searchsorted(low[order, axis], high[order, axis], side="right")
        later = until - np.arange(m) - 1
        if best is None or later.sum() < best[2].sum():
            best = axis, order, later
    axis, order, later = best
    ends = np.cumsum(later)
    turn = lambda o, p, q: (p[:, 0] - o[:, 0]) * (q[:, 1] - o[:, 1]) - (p[:, 1] - o[:, 1]) * (q[:, 0] - o[:, 0])
    at = 0
    while at < m:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        count = later[at:stop]
        first = np.repeat(np.arange(at, stop), count)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        i, j = order[first], order[second]
        apart = np.abs(i - j)
        other = 1 - axis
        keep = (apart > 1) & (apart < m - 1) & (low[i, other] <= high[j, other]) & (low[j, other] <= high[i, other])
        i, j = i[keep], j[keep]
        if ((turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]) < 0) & (turn(a[j], b[j], a[i]) * turn(a[j], b[j], b[i]) < 0)).any():
            return True
        at = stop
    return False


def simplify_ring(ring: Line, tolerance: float) -> Line:
    """As simplify(); a ring that would collapse or cross itself stays as it is."""
    out = simplify(ring, tolerance)
    return out if len(out) >= 4 and not crosses_itself(out) else ring


def area(ring: Line) -> float:
    x0, y0 = ring[0]
    return abs(sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:]))) / 2


def extremes(points: Line) -> Line:
    """The corners of the convex hull, counter-clockwise from the least; of points on a line its ends. The extremes of
    several sets' extremes are those of all their points."""
    todo = sorted(set(points))
    half: list[Line] = []
    for run in (todo, todo[::-1]):
        out: Line = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        half.append(out[:-1])
    return (half[0] + half[1]) or todo


def hull(points: Line) -> Line | None:
    """The closed convex hull; None for fewer than three distinct points or a line."""
    ring = extremes(points)
    return [*ring, ring[0]] if len(ring) > 2 else None


def merge_lines(ways: list[Line]) -> list[Line]:
    """Lines joined wherever exactly two of their ends meet; what closes becomes a closed line."""
    lines = []
    for way in ways:
        line = [p for i, p in enumerate(way) if not i or p != way[i - 1]]
        if len(line) > 1:
            lines.append(line)
    at: dict[tuple, list[tuple[int, int]]] = {}
    for n, line in enumerate(lines):
        at.setdefault(line[0], []).append((n, 0))
        at.setdefault(line[-1], []).append((n, 1))
    used = [False] * len(lines)

    def leaving(end: tuple[int, int]) -> float:
        n, side = end
        a, b = (lines[n][0], lines[n][1]) if side == 0 else (lines[n][-1], lines[n][-2])
        return math.atan2(b[1] - a[1], b[0] - a[0]) % (2 * math.pi)

    def walk(end: tuple[int, int]) -> Line:
        out: Line = []
        forward = 0
        while True:
            n, side = end
            used[n] = True
            step = lines[n] if side == 0 else lines[n][::-1]
            forward += 1 if side == 0 else -1
            out += step if not out else step[1:]
            ends = at[step[-1]]
            following = [e for e in ends if not used[e[0]]]
            if len(ends) != 2 or not following:
                return out if forward >= 0 else out[::-1]
            end = following[0]

    merged = []
    for loops in (False, True):  # first from ends and forks, then the closed loops that are left
        for node in sorted(at):
            if (len(at[node]) == 2) == loops:
                for end in sorted(at[node], key=leaving):
                    if not used[end[0]]:
                        merged.append(walk(end))
    return merged


def outline(line: Line, tolerance: float) -> tuple[str, Line] | None:
    """A joined line as a shape, simplified and rounded: a ring, or an open line; None for a ring without an area."""
    if len(line) >= 4 and line[0] == line[-1]:
        kind, out = "Polygon", simplify_ring(line, tolerance) if area(line) > 0 else None
    else:
        kind, out = "LineString", simplify(line, tolerance)
    return (kind, [(round(x, 7), round(y, 7)) for x, y in out]) if out else None
