"""The nearest street where ways are many: in tiles and blocks, with few comparisons."""

import numpy as np

from wayweft.operators import stage1, streets


def scene(points: int, lines: int, seed: int):
    rng = np.random.default_rng(seed)
    at = lambda n: np.column_stack([-120.5 + rng.random(n) * 0.05, 45.5 + rng.random(n) * 0.05])
    return at(points), np.hstack([at(lines), at(lines)])


def metres(point, lines):
    k = 111320 * np.cos(np.radians(point[1]))
    ax, ay, dx, dy = (lines[:, 0] - point[0]) * k, (lines[:, 1] - point[1]) * 110540, (lines[:, 2] - lines[:, 0]) * k, (lines[:, 3] - lines[:, 1]) * 110540
    t = np.clip(-(ax * dx + ay * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
    return np.hypot(ax + t * dx, ay + t * dy)


def test_candidates_hold_every_nearest_line_and_few_others():
    at, lines = scene(400, 3000, 1)
    lines[:50, :2], lines[50:60, 2:] = at[:50], lines[50:60, :2]
    point, line = streets.candidates(at[:, 0], at[:, 1], lines, 30.0)
    got = {i: set(line[point == i]) for i in range(len(at))}
    for i, p in enumerate(at):
        d = metres(p, lines)
        want = set(np.flatnonzero(d <= d.min() + 1e-9)) if d.min() <= 30 else set()
        assert want <= got[i] and all(d[j] <= d.min() + 1e-4 for j in got[i])


def test_dense_ways_meet_few_points(monkeypatch):
    """Pairs of points and lines that are compared grow like the points beside a line, not like all of its neighbourhood."""
    made = []
    spread = streets._spread
    monkeypatch.setattr(streets, "_spread", lambda a, b: made.append(out := spread(a, b)) or out)
    at, lines = scene(2000, 20000, 2)
    streets.candidates(at[:, 0], at[:, 1], lines, 30.0)
    assert sum(len(i) for i, _ in made) < 0.12 * len(at) * len(lines)


def test_tiles_and_blocks_change_nothing(spark, monkeypatch):
    for name, value in (("TILE", 700.0), ("POINTS", 7), ("FEWER", 50), ("SEGMENTS", 90)):
        monkeypatch.setattr(stage1, name, value)
    at, lines = scene(60, 300, 3)
    pois = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, lon double, lat double")
    roads = spark.createDataFrame([(i // 3, i % 3, f"S {i}", *map(float, x)) for i, x in enumerate(lines)], "road long, at int, street string, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.street for r in stage1.nearest_street(pois, roads).collect()}
    want = {i: f"S {d.argmin()}" for i, p in enumerate(at) if (d := metres(p, lines)).min() <= 30}
    assert got == want and len(got) > 30
