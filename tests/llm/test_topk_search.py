import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayweft.llm import topk_search as T


def brute(rows, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for q, a in whole:
        if q % 50 == 0:
            queries[q] = min(queries.get(q, a), a)
    for q, a in queries.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold(seed):
    r = np.random.default_rng(seed)
    v, q = r.integers(-9, 9, (60, 7)).astype(float), r.integers(-9, 9, (5, 7)).astype(float)
    reader = T.Reader(T.SortedLists(v), q)
    for depth in (1, 10, 59, 60):
        low, high = reader.to(depth, np.arange(5))
        assert (low <= q @ v.T + 1e-9).all() and (q @ v.T <= high + 1e-9).all()
    assert np.allclose(low, high)


def test_reading_stops():
    """Where few vectors stand out, part of the lists is enough."""
    r = np.random.default_rng(1)
    v = r.integers(-20, 20, (2000, 16)).astype(float)
    v[:8] *= 20
    q = v[:8].copy()
    readers, plain = [], T.Reader
    T.Reader = lambda *a: readers.append(plain(*a)) or readers[-1]
    try:
        got = T.search(v, np.arange(2000), q, np.arange(8) + 10_000, 5)
    finally:
        T.Reader = plain
    assert readers[0].entries < 0.7 * 8 * 2000 * 16
    for i in range(8):
        best = sorted(((-int(x), j) for j, x in enumerate(v @ q[i])))[:5]
        assert [(j, -s) for s, j in best] == [(c, s) for a, c, s in got if a == 10_000 + i]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 40 * 6)
    monkeypatch.setattr(T, "BLOCK", 3 * 6)
    monkeypatch.setattr(T, "PILOT", 20)
    r = random.Random(2)
    base = [[r.gauss(0, 0.2) for _ in range(6)] for _ in range(30)]
    rows = [(i, r.choice(base) if r.random() < 0.5 else [r.gauss(0, 0.2) for _ in range(6)]) for i in range(700)]
    rows += [(900, None), (950, []), (1000, [1.0, None]), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6), (1150, [0.5, 0.25]), (1151, [0.5, -0.25]), (100, base[0]), (None, base[1]), (7, base[2])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, id int")
    assert sorted(tuple(x) for x in T.top_k(df, F.col("id") % 50 == 0).collect()) == brute(rows)
    assert T.top_k(df.where("false"), F.col("id") % 50 == 0).collect() == []


def test_large_components(spark):
    """Products that doubles cannot add exactly."""
    rows = [(i, [float((i * 7919) % 1000 + 1) * 1e6 + i % 2, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in T.top_k(df, F.col("id") % 50 == 0, scale=1).collect())
    want = []
    for q in (0, 50):
        best = sorted((-int(rows[q][1][0]) * int(rows[i][1][0]) - 1, i) for i in range(60) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_components_beyond_any_range(spark):
    """Exact order; scores beyond a long are its end; what overflows when scaled takes no part."""
    values = [1e17, -1e17, 3e200, 2e200, 1e300, 1e308, 5.0, 2.0**60, -(2.0**61)]
    rows = [(i, [x, 1.0]) for i, x in enumerate(values)]
    got = sorted(tuple(x) for x in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect())
    whole = {i: [int(math.floor(256 * x)) for x in v] for i, v in rows if math.isfinite(256 * v[0])}
    best = sorted((-sum(a * b for a, b in zip(whole[0], v)), i) for i, v in whole.items() if i)[:5]
    assert got == [(0, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]


def test_memory_does_not_grow_with_a_blocks_queries():
    """A block's bounds are held for some of its queries at once: 2048 queries of 16384 vectors would take 268 MB a matrix."""
    import tracemalloc

    rng = np.random.default_rng(5)
    vectors, asked = np.floor(rng.normal(size=(16384, 8)) * 256), np.floor(rng.normal(size=(2048, 8)) * 256)
    tracemalloc.start()
    got = T.search(vectors, np.arange(16384), asked, np.arange(2048) + 50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
    scores = asked @ vectors.T
    for q in range(0, 2048, 97):
        order = sorted(range(16384), key=lambda i: (-scores[q, i], i))[:5]
        assert [(i, s) for query, i, s in got[q * 5 : q * 5 + 5]] == [(i, int(scores[q, i])) for i in order]
