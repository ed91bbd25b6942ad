import numpy as np
from pyspark.sql import functions as F

from wayweft.plans import queries, synthetic

SF = "/root/testdata/sf0.001"


def test_all_ways_against_brute_force(spark):
    """Every point against every segment of every way."""
    roads = []
    for way, pts in queries._ways(spark, SF).select("way", F.transform("pts", lambda p: F.array(p.lon, p.lat))).collect():
        roads += [(way, at, *p, *q) for at, (p, q) in enumerate(zip(pts, pts[1:]))]
    roads.sort()
    way, _, x1, y1, x2, y2 = np.array(roads).T
    assert len(set(way % 40)) == 40
    want = {}
    for key, lon, lat in synthetic.pois(spark, SF).select("id", "lon", "lat").collect():
        k = 111320 * np.cos(np.radians(lat))
        ax, ay, dx, dy = (x1 - lon) * k, (y1 - lat) * 110540, (x2 - x1) * k, (y2 - y1) * 110540
        size = dx * dx + dy * dy
        t = np.clip(-(ax * dx + ay * dy) / np.where(size > 0, size, 1), 0, 1)
        metres = np.hypot(ax + t * dx, ay + t * dy)
        if metres.min() <= 30:
            want[key] = {f"Way {int(w) % 50}" for w in way[metres <= metres.min() + 1e-6]}
    got = {x.id: x.street for x in queries.street_snap(spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[key] in streets for key, streets in want.items())
