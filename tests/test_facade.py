import io
import json
import os
import zipfile

import pytest

from wayweft import options as knobs
from wayweft.options import Options
from wayweft.plans import facade
from wayweft.plans import model as M
from wayweft.sources import geojson, writers
from wayweft.streaming import drops

TOWN = {
    "type": "FeatureCollection",
    "properties": {"schemaVersion": 1, "title": "Twin & Town", "bounds": [-1.0, 50.0, -0.99, 50.01]},
    "features": [
        {"type": "Feature", "properties": {"kind": "place", "name": "Old Side", "osmId": "n1"}, "geometry": {"type": "Point", "coordinates": [-0.999, 50.001]}},
        {"type": "Feature", "properties": {"kind": "poi", "name": "Hall", "osmId": "n2", "category": "civic.townhall", "importance": 90, "tier": "landmark", "street": "High St"}, "geometry": {"type": "Point", "coordinates": [-0.9991, 50.0012]}},
        {"type": "Feature", "properties": {"kind": "poi", "name": "Inn, The", "osmId": "n3", "category": "food.pub", "importance": 65, "tier": "destination", "street": "High St"}, "geometry": {"type": "Point", "coordinates": [-0.998, 50.0019]}},
        {"type": "Feature", "properties": {"kind": "poi", "osmId": "n4", "category": "landmark.church", "importance": 85, "tier": "landmark"}, "geometry": {"type": "Point", "coordinates": [-0.9905, 50.009]}},
        {"type": "Feature", "properties": {"kind": "poi", "name": "Elm House", "osmId": "n5", "category": "residential.house", "importance": 40}, "geometry": {"type": "Point", "coordinates": [-0.9982, 50.0015]}},
        {"type": "Feature", "properties": {"kind": "poi", "osmId": "n6", "category": "landmark.pier", "importance": 40}, "geometry": {"type": "Point", "coordinates": [-0.9981, 50.0015]}},
        {"type": "Feature", "properties": {"kind": "water", "name": "Mere", "osmId": "w1"}, "geometry": {"type": "Polygon", "coordinates": [[[-0.997, 50.003], [-0.993, 50.003], [-0.993, 50.007], [-0.997, 50.007], [-0.997, 50.003]]]}},
        {"type": "Feature", "properties": {"kind": "park", "name": "Pocket", "osmId": "w2"}, "geometry": {"type": "Polygon", "coordinates": [[[-0.9985, 50.001], [-0.9984, 50.001], [-0.9984, 50.0011], [-0.9985, 50.001]]]}},
    ],
}


@pytest.fixture(scope="module")
def built(spark):
    c = geojson.parse(spark, json.dumps(TOWN))
    return M.build(geojson.features(c), geojson.meta(c))


def test_model_and_options(built):
    plain = M.markdown(built)
    assert "[03] Inn, The (food.pub)" in plain and "[02] church · Old Side · stands apart — reached only across water" in plain and "(far) [separated by water]" in plain and "clustered: ~2 minor" in plain and "Pocket" not in plain and "Mere (water)" in plain
    other = M.markdown(built, Options(preamble=False, bidirectional=True, inline_name=True, minor_features=True))
    assert "canon" not in other and "→ [02] church — ~" in other and "minor: Elm House\nprops: ~1\n" in other and other.count("   → ") == 2 * plain.count("   → ")


def test_json_round_trip(spark, built):
    first = json.loads(facade.to_json(built, Options(chunking=True, scene_size=1)))
    assert len(first["features"]) == 3 and len(first["minors"]) == 2 and first["chunks"] and "| Area |" in first["manifest"]
    assert sorted(t for ch in first["chunks"] for t in ch["tokens"]) == ["[01]", "[02]", "[03]"]
    again = json.loads(facade.render_from_model(spark, json.dumps(first), '{"chunking": true}'))
    assert {k: again[k] for k in ("features", "minors", "edges", "districts", "terrain", "markdown")} == {k: first[k] for k in ("features", "minors", "edges", "districts", "terrain", "markdown")}
    assert "error" in json.loads(facade.render_from_model(spark, "null")) and "error" in json.loads(facade.from_geojson(spark, "{oops")) and "error" in json.loads(facade.from_osm(spark, "/nowhere.osm"))


def test_parse_options():
    assert knobs.parse(None) == knobs.parse(" ") == Options()
    assert knobs.parse('{"Bidirectional": true, "sceneSize": "tight", "minorFeatures": true}') == Options(bidirectional=True, scene_size=8, minor_features=True)
    assert knobs.scene_size("huge") == 14


def test_writers(spark, built, tmp_path):
    c = geojson.parse(spark, json.dumps(TOWN))
    text = writers.geojson(geojson.features(c), geojson.meta(c))
    assert json.loads(text) == TOWN
    assert writers.run_summary(geojson.features(c), geojson.meta(c)) == "Twin & Town: 8 features\n  park: 1\n  place: 1\n  poi: 5\n  water: 1\n"
    assert writers.default_output("a/b.osm") == "a/b.map.md"
    chunks = M.scene_chunks(built, Options(chunking=True, scene_size=2))
    with zipfile.ZipFile(io.BytesIO(writers.archive(chunks, "m"))) as z:
        assert z.read("manifest.md") == b"m" and len(z.namelist()) == chunks.count() + 1


def test_unreadable_point(spark):
    bad = json.loads(json.dumps(TOWN))
    bad["features"][1]["geometry"]["coordinates"] = [1]
    assert "unreadable point" in json.loads(facade.from_geojson(spark, json.dumps(bad)))["error"]


def test_drops(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.geojson").write_text(json.dumps(TOWN))
    seen = []
    q = drops.watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda path, m: seen.append((path.rsplit("/", 1)[1], m.promoted.count())), available_now=True)
    q.awaitTermination(120)
    assert seen == [("a.geojson", 3)]
