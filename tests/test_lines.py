"""Lines joined across tasks, against the same joined one after another."""

import math
import random

from wayweft.operators import kernels, stage1
from wayweft.operators.lines import merged_lines

DDL = "key long, at long, pts array<struct<lon:double,lat:double>>"


def table(spark, shapes):
    return spark.createDataFrame([(k, n, [{"lon": float(x), "lat": float(y)} for x, y in way]) for k, ways in shapes.items() for n, way in enumerate(ways)], DDL)


def joined(spark, shapes):
    got: dict = {}
    for r in merged_lines(table(spark, shapes)).orderBy("key", "n").collect():
        got.setdefault(r["key"], []).append([(p["lon"], p["lat"]) for p in r["pts"]])
    return got


def plainly(shapes):
    return {k: made for k, ways in shapes.items() if (made := kernels.merge_lines([[(float(x), float(y)) for x, y in w] for w in ways]))}


def cut(rng, ring, parts, closed=True):
    """A line in that many pieces, some turned, in any order."""
    stops = sorted(rng.sample(range(1, len(ring) - 1), parts - 1))
    pieces = [ring[a : b + 1] for a, b in zip([0, *stops], [*stops, len(ring) - 1])]
    pieces = [p[::-1] if rng.random() < 0.5 else p for p in pieces]
    rng.shuffle(pieces)
    return pieces


def circle(x, y, r, n):
    ring = [(round(x + r * math.cos(2 * math.pi * k / n), 6), round(y + r * math.sin(2 * math.pi * k / n), 6)) for k in range(n)]
    return [*ring, ring[0]]


def test_any_shapes(spark):
    rng = random.Random(11)
    shapes = {}
    for key in range(40):  # streets on a small grid: forks, crossings, dead ends, closed ones, the same line twice
        ways = []
        for _ in range(rng.randint(1, 9)):
            x, y = rng.randint(0, 4), rng.randint(0, 4)
            way = [(x, y)]
            for _ in range(rng.randint(0, 4)):
                x, y = rng.choice([(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1), (x, y)])
                way.append((x, y))
            ways.append(way)
        shapes[key] = ways
    shapes[100] = cut(rng, circle(0, 0, 1, 60), 9) + cut(rng, circle(5, 0, 1, 40), 4) + [circle(9, 9, 1, 12)] + cut(rng, circle(5, 5, 1, 50)[:-5], 7)
    shapes[101] = [[(1, 1)], [(2, 2), (2, 2)], []]
    assert joined(spark, shapes) == plainly(shapes)
    assert joined(spark, {}) == {}


def test_a_coast_of_thousands_of_ways(spark):
    """One key with a ring of 3000 ways and an open line of 1500, in more than one task, in a few rounds."""
    rng = random.Random(2)
    shapes = {7: cut(rng, circle(0, 0, 1, 9000), 3000) + cut(rng, circle(5, 5, 2, 6000)[:-100], 1500)}
    made = joined(spark, shapes)
    assert made == plainly(shapes) and len(made[7]) == 2


def test_outlines_alike_at_every_size(spark):
    rng = random.Random(4)
    shapes = {1: cut(rng, circle(0, 0, 0.01, 80), 6) + [[(1, 1), (1, 2)]], 2: [[(0, 0), (1, 1), (2, 2), (0, 0)]], 3: cut(rng, circle(3, 3, 0.02, 90)[:-9], 5)}
    outer = table(spark, shapes).withColumnsRenamed({"key": "id", "at": "m_at"})
    rows = lambda limit: sorted(map(str, stage1.outlines(outer, limit).collect()))
    one, many = ([r.split("n=")[0] + r.split("geom_type=")[1] for r in rows(limit)] for limit in (10**9, 0))
    assert one == many and len(one) == 3
