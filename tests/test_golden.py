"""The whole document of a small town, byte by byte."""

import json
import os

from wayweft.options import Options
from wayweft.plans import model as M
from wayweft.sources import geojson

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "golden")


def town():
    """A place on each side of a rail line, a lake between, ten points of interest and their houses."""
    point = lambda kind, i, lon, lat, **p: {"type": "Feature", "properties": {"kind": kind, "osmId": f"n{i}", **p}, "geometry": {"type": "Point", "coordinates": [lon, lat]}}
    names = ["Hill Fort", "Museum", "Bakery", "Old Inn", "Tea Room", "Book Nook", "Grange School", "Green Grocer", "Tailor", None]
    kinds = ["landmark.ruins", "landmark.museum", "shop.bakery", "food.pub", "food.cafe", "shop.books", "civic.school", "shop.greengrocer", "shop.tailor", "landmark.church"]
    rows = [point("place", 1, 4.001, 52.001, name="West Bank"), point("place", 2, 4.009, 52.004, name="East Bank")]
    for i, (name, kind) in enumerate(zip(names, kinds)):
        p = {"category": kind, "importance": 95 - 5 * i, "tier": "landmark", "street": "Long Lane" if i % 3 else "Short Row", **({"name": name} if name else {}), **({"streetApprox": True} if i == 4 else {})}
        rows.append(point("poi", 10 + i, round(4.0005 + 0.0011 * i, 4), round(52.0008 + 0.0004 * ((i * 7) % 10), 4), **p))
    rows += [point("poi", 30 + i, round(4.0012 + 0.002 * i, 4), 52.002, category="residential.house", importance=40, name=n) for i, n in enumerate(["Ash", "ash", "Oak", "Elm"])]
    rows.append(point("poi", 40, 4.0015, 52.0021, category="landmark.tower", importance=50))
    rows.append({"type": "Feature", "properties": {"kind": "barrier", "name": "Coast Line", "osmId": "w1", "barrierClass": "rail"}, "geometry": {"type": "LineString", "coordinates": [[4.0055, 52.0], [4.0057, 52.006]]}})
    rows.append({"type": "Feature", "properties": {"kind": "water", "name": "Mere", "osmId": "w2"}, "geometry": {"type": "Polygon", "coordinates": [[[4.007, 52.003], [4.0085, 52.003], [4.0085, 52.0035], [4.007, 52.0035], [4.007, 52.003]]]}})
    return {"type": "FeatureCollection", "properties": {"schemaVersion": 1, "title": "Twin Banks", "bounds": [4.0, 52.0, 4.012, 52.006]}, "features": rows}


def built(spark):
    c = geojson.parse(spark, json.dumps(town()))
    return M.build(geojson.features(c), geojson.meta(c))


def read(name):
    with open(os.path.join(HERE, name), encoding="utf-8") as f:
        return f.read()


def test_document_and_chunks(spark):
    m = built(spark)
    assert M.markdown(m) == read("twin_banks.md")
    assert M.markdown(m, Options(minor_features=True, preamble=False, inline_name=True, bidirectional=True)) == read("twin_banks_other.md")
    chunks = M.scene_chunks(m, Options(chunking=True, scene_size=3))
    rows = chunks.orderBy("ord").collect()
    assert "\n".join(r.markdown for r in rows) == read("twin_banks_chunks.md") and M.manifest(m, chunks) == read("twin_banks_manifest.md")
    assert sorted(t for r in rows for t in r.tokens) == sorted(r.token for r in m.promoted.collect()) and len({r.slug for r in rows}) == len(rows)
