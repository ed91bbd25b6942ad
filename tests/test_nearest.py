import random

import pytest

from wayweft.operators.nearest import nearest_k

from tests.test_stage1 import metres


@pytest.mark.parametrize("k,own", [(1, False), (3, True)])
def test_grid_equals_brute_force(spark, k, own):
    r = random.Random(k)
    spots = [(i, 5 + r.gauss(0, 0.01), 60 + r.gauss(0, 0.01)) for i in range(150)] + [(150 + i, 5.5, 60.5) for i in range(4)]
    points = spots if own else [(i, 5 + r.gauss(0, 0.02), 60 + r.gauss(0, 0.02)) for i in range(80)]
    got = nearest_k(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(spots, "ord long, lon double, lat double"), k, own, few=0).collect()
    want = set()
    for i, *p in points:
        best = sorted((metres(p, q), o) for o, *q in spots if not own or o != i)[:k]
        want |= {(i, o, n) for n, (_, o) in enumerate(best, 1)}
    assert {(x.id, x.ord, x.rank) for x in got} == want


def brute(points, spots, k, own):
    want = set()
    for i, *p in points:
        best = sorted((metres(p, q), o) for o, *q in spots if not own or o != i)[:k]
        want |= {(i, o, n) for n, (_, o) in enumerate(best, 1)}
    return want


@pytest.mark.parametrize("few", [0, 10_000])
def test_antimeridian_poles_and_far_points(spark, few):
    """Both ways find the same neighbours across the date line and around a pole, however far they are."""
    r = random.Random(3)
    spots = [(i, r.choice([-1, 1]) * (180 - r.random() * 0.02), r.uniform(-0.02, 0.02)) for i in range(120)] + [(200 + i, r.uniform(-180, 180), 90 - r.random() * 0.01) for i in range(120)] + [(400, 10.0, 10.0)]
    points = [(i, r.choice([-1, 1]) * (180 - r.random() * 0.03), r.uniform(-0.03, 0.03)) for i in range(40)] + [(100 + i, r.uniform(-180, 180), 90 - r.random() * 0.02) for i in range(40)] + [(300 + i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(40)]
    got = nearest_k(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(spots, "ord long, lon double, lat double"), 2, few=few).collect()
    assert {(x.id, x.ord, x.rank) for x in got} == brute(points, spots, 2, False)


def test_a_dense_town_in_a_wide_land(spark):
    """Most targets in one place or within some metres, others far apart."""
    r = random.Random(4)
    spots = [(i, 7.0, 50.0) for i in range(300)] + [(300 + i, 7 + r.gauss(0, 0.0005), 50 + r.gauss(0, 0.0005)) for i in range(400)] + [(800 + i, r.uniform(0, 14), r.uniform(45, 55)) for i in range(40)]
    got = nearest_k(spark.createDataFrame(spots, "id long, lon double, lat double"), spark.createDataFrame(spots, "ord long, lon double, lat double"), 3, True, few=0).collect()
    assert {(x.id, x.ord, x.rank) for x in got} == brute(spots, spots, 3, True)
