import math
import random
import time

from wayweft.operators import kernels, stage1


def quadratic(ring):
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    edges = list(zip(ring, ring[1:]))
    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 2 : len(edges) - (i == 0)]:
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return True
    return False


def round_shape(n, rough, seed):
    r = random.Random(seed)
    at = [2 * math.pi * i / n for i in range(n)]
    ring = [((1 + rough * r.random()) * math.cos(t), (1 + rough * r.random()) * math.sin(t)) for t in at]
    return [*ring, ring[0]]


def test_crossings_against_all_pairs(monkeypatch):
    monkeypatch.setattr(kernels, "PAIRS", 50)
    seen = set()
    for seed in range(300):
        r = random.Random(seed)
        if seed % 2:
            ring = round_shape(r.randrange(4, 40), r.choice([0.0, 0.05, 0.4]), seed)
        else:
            ring = [(r.randrange(6), r.randrange(6)) for _ in range(r.randrange(4, 9))]
            ring.append(ring[0])
        assert kernels.crosses_itself(ring) == quadratic(ring)
        seen.add(quadratic(ring))
    assert seen == {True, False}


def test_a_ring_of_fifty_thousand_vertices():
    ring = round_shape(50_000, 0.00001, 1)
    began = time.time()
    assert not kernels.crosses_itself(round_shape(50_000, 0, 1))
    assert len(kernels.simplify_ring(ring, 0.00004)) < 10_000
    assert time.time() - began < 20


def test_hulls_of_parts(spark):
    """Hulls over many rows of a key and many tasks equal the hull of all its points."""
    r = random.Random(6)
    points = {k: [(round(r.gauss(0, 1), 3), round(r.gauss(0, 1), 3)) for _ in range(400)] for k in range(5)} | {7: [(float(i), 2.0 * i) for i in range(9)], 8: [(1.0, 1.0)]}
    rows = [(k, [{"lon": x, "lat": y} for x, y in p[i : i + 7]]) for k, p in points.items() for i in range(0, len(p), 7)] + [(0, [])]
    df = spark.createDataFrame(rows, "id long, pts array<struct<lon:double,lat:double>>").repartition(6)
    got = {x.id: [(p.lon, p.lat) for p in x.pts] for x in stage1.hulls(df, "id").collect()}
    assert got == {k: h for k, p in points.items() if (h := kernels.hull(p))} and set(got) == set(range(5))
    assert stage1.hulls(df.where("false"), "id").collect() == []


def test_labels_one_by_one(spark):
    from wayweft.operators import labels

    r = random.Random(2)
    rows = [(f"t{i:03}", r.randrange(300), r.randrange(200), r.randrange(5, 60), 12, i % 41 == 0, r.randrange(4)) for i in range(250)]
    df = spark.createDataFrame(rows, "token string, x int, y int, width int, height int, forced boolean, importance int").repartition(3)
    for limit in (None, 20):
        kept = []
        for t, x, y, w, h, forced, _ in sorted(rows, key=lambda a: (not a[5], -a[6], a[0])):
            free = all(x + w <= a or a + c <= x or y + h <= b or b + d <= y for _, a, b, c, d in kept)
            if forced or (free and (limit is None or len(kept) < limit)):
                kept.append((t, x, y, w, h))
        assert sorted(x.token for x in labels.placed(df, limit).collect()) == sorted(k[0] for k in kept)
    assert labels.placed(df.where("false")).collect() == []
