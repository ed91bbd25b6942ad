"""Points in rings by cells, against the plain ray to the east."""

import math
import random

import pytest

from wayweft.operators import graph


def plainly(points, rings):
    found = set()
    for rank, lon, lat in points:
        for ring in rings:
            odd = False
            for (ix, iy), (jx, jy) in zip(ring, ring[-1:] + ring[:-1]):
                if (iy > lat) != (jy > lat) and lon < (jx - ix) * (lat - iy) / (jy - iy) + ix:
                    odd = not odd
            if odd:
                found.add(rank)
    return found


def asked(spark, points, rings, cell):
    rows = [(n, [{"lon": float(x), "lat": float(y)} for x, y in ring]) for n, ring in enumerate(rings)]
    table = spark.createDataFrame(rows, "pos long, pts array<struct<lon:double,lat:double>>")
    dots = spark.createDataFrame(points, "rank long, lon double, lat double")
    return {r[0] for r in graph.points_in_rings(dots, table, cell).collect()}


def star(rng, x, y, size, n):
    spokes = [(2 * math.pi * k / n, size * rng.uniform(0.3, 1)) for k in range(n)]
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in spokes]


@pytest.mark.parametrize("cell", [0.005, 0.05, 1.0])
def test_stars_and_crossed_rings(spark, cell):
    rng = random.Random(7)
    rings = [star(rng, rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), rng.uniform(0.01, 0.6), rng.randint(3, 60)) for _ in range(12)]
    rings += [[(rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5)) for _ in range(15)] for _ in range(3)]  # these cross themselves
    points = [(n, rng.uniform(-1, 1), rng.uniform(-1, 1)) for n in range(1500)]
    assert asked(spark, points, rings, cell) == plainly(points, rings)


def test_corners_on_the_grid(spark):
    """Edges along lines of the grid, corners on its crossings, teeth of one column, and points on the grid's lines."""
    teeth = [(x, 1.0 if x % 2 else 9.0) for x in range(20)]
    rings = [[(0.0, -1.0), *teeth, (20.0, -1.0)], [(-6, -6), (-2, -6), (-2, -2), (-6, -2)], [(-5, -5), (-3, -5), (-3, -3), (-5, -3)]]
    rng = random.Random(3)
    points = [(n, rng.randint(-14, 42) / 2 + 0.13, rng.randint(-14, 22) / 2) for n in range(600)]
    points += [(600 + n, float(rng.randint(-7, 21)), rng.randint(-7, 11) + 0.37) for n in range(600)]
    assert asked(spark, points, rings, 1.0) == plainly(points, rings)


def test_a_lake_of_many_cells(spark):
    """Runs of thousands of columns, in both signs of the longitude; and no ring at all."""
    lake = [(-100.0, -0.02), (0.0, -0.031), (90.0, -0.02), (120.0, 0.02), (-101.0, 0.03)]
    rng = random.Random(5)
    points = [(n, rng.uniform(-130, 130), rng.uniform(-0.04, 0.04)) for n in range(800)]
    assert asked(spark, points, [lake], 0.005) == plainly(points, [lake])
    assert asked(spark, points, [], 0.005) == set()
