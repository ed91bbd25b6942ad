import math
import random

import pytest
from pyspark.sql import functions as F

from wayweft.operators import classify, kernels, stage1
from wayweft.plans import model as M
from wayweft.plans import normalize

CLASSES = [
    ({"amenity": "cafe", "name": "A B"}, "food.cafe", 65, "destination", "budgeted"),
    ({"amenity": "bench", "name": "A B"}, None, 0, "", ""),
    ({"natural": "tree", "shop": "books"}, None, 0, "", ""),
    ({"tourism": "museum"}, "landmark.museum", 85, "landmark", "core"),
    ({"tourism": "artwork", "name": "Mural"}, "landmark.artwork", 60, "destination", "budgeted"),
    ({"amenity": "place_of_worship"}, "landmark.place_of_worship", 85, "landmark", "core"),
    ({"historic": "memorial", "name": "Mm"}, "landmark.memorial", 60, "destination", "budgeted"),
    ({"man_made": "pier", "name": "Pier 5"}, "landmark.pier", 95, "landmark", "core"),
    ({"amenity": "dentist", "name": "Dr. No"}, "civic.dentist", 65, "destination", "budgeted"),
    ({"office": "government", "name": "Dept"}, "civic.government", 55, "destination", "budgeted"),
    ({"railway": "station"}, None, 0, "", ""),
    ({"railway": "station", "name": "Main"}, "civic.station", 90, "landmark", "core"),
    ({"shop": "deli", "brand": "Xx"}, "food.deli", 50, "destination", "budgeted"),
    ({"amenity": "cafe", "brand": "Chain", "name": "Ch"}, "food.cafe", 50, "destination", "budgeted"),
    ({"building": "university", "name": "Hall One"}, "civic.university_building", 65, "destination", "budgeted"),
    ({"building": "dormitory", "name": "A"}, None, 0, "", ""),
    ({"building": "house", "name": "Elm House"}, "residential.house", 40, "minor", "clustered"),
    ({"building": "house", "name": "12"}, None, 0, "", ""),
    ({"leisure": "marina", "name": "Dock"}, "leisure.marina", 65, "destination", "core"),
    ({"craft": "brewery"}, "shop.brewery", 55, "destination", "budgeted"),
]


def test_classes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CLASSES)], "i int, tags map<string,string>")
    got = {r.i: (r.category, r.importance, r.tier, r.salience) for r in classify.classified(df, classify.tags_of()).collect()}
    assert got == {i: tuple(x[1:]) for i, x in enumerate(CLASSES) if x[1]}


def test_terrain_classes(spark):
    cases = [({"highway": "trunk", "ref": "R9"}, "R9", "motorway", None), ({"railway": "rail", "name": " "}, None, None, None), ({"waterway": "river", "name": "Mill"}, "Mill", "water", None), ({"natural": "bay", "name": "B"}, None, None, "water"), ({"leisure": "park", "name": "P"}, None, None, "park"), ({"natural": "wetland", "name": "W"}, None, None, "park"), ({"leisure": "park"}, None, None, None), ({"amenity": "grave_yard", "name": "G", "leisure": "x"}, None, None, "park")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, tags map<string,string>")
    tag = classify.tags_of()
    got = df.select("i", *[x.alias(n) for x, n in zip((*classify.barrier_of(tag), classify.area_of(tag)), "lca")]).orderBy("i").collect()
    assert [(r.l, r.c, r.a) for r in got] == [c[1:] for c in cases]


def metres(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def test_merge_against_greedy(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        rows.append((f"n{i}", r.choice([None, "", "X", "Y"]), r.choice(["food.cafe", "food.bar", "shop.a", None]), r.randrange(3), -120 + r.random() * 0.004, 45 + r.random() * 0.003))
    df = spark.createDataFrame(rows, "osm_id string, name string, category string, importance int, lon double, lat double").repartition(3)
    kept = []
    for f in sorted(rows, key=lambda x: (not x[1], -x[3], x[0])):
        for k in kept:
            if f[2] and k[2] and f[2].split(".")[0] == k[2].split(".")[0] and metres(f[4:], k[4:]) <= 40 and ((f[1] and f[1] == k[1]) or (not f[1] and k[1])):
                break
        else:
            kept.append(f)
    assert sorted(x.osm_id for x in stage1.merged(df).collect()) == sorted(k[0] for k in kept)


def test_streets_against_brute_force(spark):
    r = random.Random(5)
    pois = [(i, 10 + r.random() * 0.01, 50 + r.random() * 0.01) for i in range(200)]
    roads = [(i, 0, f"s{i}", 10 + r.random() * 0.01, 50 + r.random() * 0.01, 10 + r.random() * 0.01, 50 + r.random() * 0.01) for i in range(12)]
    got = {x.id: x.street for x in stage1.nearest_street(spark.createDataFrame(pois, "id long, lon double, lat double"), spark.createDataFrame(roads, "road long, at int, street string, x1 double, y1 double, x2 double, y2 double")).collect()}
    want = {}
    for i, lon, lat in pois:
        best = None
        for _, _, name, x1, y1, x2, y2 in roads:
            kx, ky = 111_320 * math.cos(math.radians(lat)), 110_540
            ax, ay, dx, dy = (x1 - lon) * kx, (y1 - lat) * ky, (x2 - x1) * kx, (y2 - y1) * ky
            t = max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            d = math.hypot(ax + t * dx, ay + t * dy)
            if best is None or d < best[0]:
                best = (d, name)
        if best[0] <= 30:
            want[i] = best[1]
    assert got == want and len(want) > 20


def test_kernels():
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert kernels.hull([*square, (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)] and kernels.hull([(0, 0), (1, 1), (2, 2)]) is None
    (line,) = kernels.merge_lines([[(0, 0), (4, 0), (4, 2)], [(0, 0), (0, 4), (2, 4)], [(4, 2), (2, 2), (2, 4)]])
    kind, ring = kernels.outline(line, 1e-9)
    assert kind == "Polygon" and kernels.area(ring) == 12
    (line,) = kernels.merge_lines([[(0, 0), (4, 0)], [(4, 0), (4, 2)]])
    assert kernels.outline(line, 1e-9)[0] == "LineString" and kernels.outline([(0, 0), (1, 1), (2, 2), (0, 0)], 1e-9) is None
    assert kernels.simplify([(0, 0), (1, 0.00001), (2, 0)], 0.000045) == [(0, 0), (2, 0)]


XML = """<osm>
<node id="1" lat="45.0" lon="-120.0"><tag k="place" v="neighbourhood"/><tag k="name" v="Old Town"/></node>
<node id="2" lat="45.0001" lon="-120.0001"><tag k="amenity" v="place_of_worship"/><tag k="name" v="St. Ann"/></node>
<node id="3" lat="45.0001" lon="-120.00011"><tag k="amenity" v="place_of_worship"/></node>
<node id="4" lat="45.0001" lon="-120.00012"><tag k="amenity" v="place_of_worship"/><tag k="name" v="St. Ann"/></node>
<node id="5" lat="45.001" lon="-120.001"><tag k="amenity" v="cafe"/><tag k="name" v="x"/><tag k="name" v="Far Cafe"/></node>
<node id="6" lat="45.0002" lon="-120.002"/><node id="7" lat="45.0002" lon="-119.998"/>
<node id="8" lat="45.002" lon="-120.002"/><node id="9" lat="45.002" lon="-120.001"/><node id="10" lat="45.003" lon="-120.001"/><node id="11" lat="45.003" lon="-120.002"/>
<way id="20"><nd ref="6"/><nd ref="7"/><tag k="highway" v="residential"/><tag k="name" v="Main St"/></way>
<way id="21"><nd ref="8"/><nd ref="9"/><nd ref="10"/><nd ref="11"/><nd ref="8"/><tag k="building" v="university"/><tag k="name" v="Big Hall"/></way>
<way id="22"><nd ref="6"/><nd ref="7"/><tag k="railway" v="rail"/><tag k="name" v="Line 1"/></way>
<way id="23"><nd ref="8"/><nd ref="9"/><nd ref="10"/></way><way id="24"><nd ref="10"/><nd ref="11"/><nd ref="8"/></way>
<relation id="30"><member type="way" ref="23" role="outer"/><member type="way" ref="24" role=""/><member type="way" ref="99" role="outer"/><tag k="type" v="multipolygon"/><tag k="natural" v="water"/><tag k="name" v="Lake"/></relation>
<relation id="31"><member type="way" ref="23" role="outer"/><tag k="type" v="multipolygon"/><tag k="natural" v="water"/><tag k="name" v="Clipped"/></relation>
</osm>"""


@pytest.fixture(scope="module")
def extract(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("osm") / "town.osm"
    path.write_text(XML)
    return str(path)


def test_extract(spark, extract):
    rows, meta = normalize.from_osm(spark, extract)
    got = {r.osm_id + "/" + r.kind: r for r in rows.collect()}
    assert sorted(got) == ["n1/place", "n2/poi", "n5/poi", "r30-0/water", "r31-L0/water", "w21/poi", "w22/barrier"]
    assert got["n5/poi"].name == "Far Cafe" and got["n2/poi"].street == "Main St" and got["n2/poi"].street_approx is True
    assert got["w21/poi"].importance == 65 + min(9, round(5 * math.log10(8_760 / 200))) and got["r30-0/water"].geom_type == "Polygon" and len(got["r30-0/water"].pts) == 5
    assert meta.first().title == "Old Town" and meta.first().bounds == [-120.002, 45.0, -119.998, 45.003]


def test_both_stages(spark, extract):
    built = normalize.build(spark, extract)
    text = M.markdown(built)
    assert "[01] St. Ann (landmark.place_of_worship) · near Main St" in text or "St. Ann (landmark.place_of_worship)" in text
    assert "### Old Town" in text and "Line 1 (barrier:rail)" in text
    with pytest.raises(ValueError):
        normalize.build(spark, "x.pbf")


def test_representative_point_of_ring(spark):
    from wayweft.functions import geo

    df = spark.range(1).select(F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))]).alias("p"))
    assert tuple(df.select(geo.representative_point(F.col("p")).alias("x")).first().x) == (1.0, 0.5)
