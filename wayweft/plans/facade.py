"""JSON in, JSON out: a model of an input, a model rendered again with other options, and errors as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import options as knobs
from ..functions import geo
from ..options import Options
from ..sources import geojson
from . import model, normalize

# The model's JSON names, table by table.
_PROMOTED = {"token": "token", "name": "name", "category": "category", "importance": "importance", "tier": "tier", "street": "street", "street_approx": "streetApprox", "district": "district", "lon": "lon", "lat": "lat"}
_MINORS = {"name": "name", "category": "category", "named": "named", "district": "district", "lon": "lon", "lat": "lat"}
_EDGES = {"from_token": "fromToken", "to_token": "toToken", "to_name": "toName", "meters": "meters", "dir": "dir", "bucket": "bucket", "crosses": "crosses", "separated_by_water": "separatedByWater"}
_DISTRICTS = {"name": "name", "street": "street", "spine_dir": "spineDir", "spine_tokens": "spineTokens", "promoted_count": "promotedCount", "clustered_count": "clusteredCount", "named_minors": "namedMinors", "prop_count": "propCount", "anchor_lon": "anchorLon", "anchor_lat": "anchorLat"}
_TERRAIN = {"name": "name", "kind": "kind", "kind_label": "kindLabel", "note": "note", "position": "position", "geometry_type": "geometryType", "parts": "parts"}
_CHUNKS = {"name": "name", "slug": "slug", "anchor_token": "anchorToken", "anchor_name": "anchorName", "bounds": "bounds", "tokens": "tokens", "neighbours": "neighbours", "markdown": "markdown"}


def _plain(value):
    if isinstance(value, Row):
        return [value["lon"], value["lat"]] if set(value.__fields__) == {"lon", "lat"} else {k: _plain(value[k]) for k in value.__fields__}
    return [_plain(x) for x in value] if isinstance(value, list) else value


def _rows(table: DataFrame, names: dict[str, str], *order: str) -> list[dict]:
    return [{names[k]: _plain(r[k]) for k in names if r[k] is not None} for r in table.orderBy(*order).collect()]


def to_json(built: model.Model, options: Options = Options()) -> str:
    """The whole model of one map, with its text, in camel case and without nulls."""
    meta = built.meta.first()
    chunks = model.scene_chunks(built, options) if options.chunking and not built.promoted.isEmpty() else None
    return json.dumps(
        {
            "title": meta["title"], "bounds": list(meta["bounds"]), "features": _rows(built.promoted, _PROMOTED, "rank"), "minors": _rows(built.minors, _MINORS, "pos"), "edges": _rows(built.edges, _EDGES, "src", "ord"),
            "districts": _rows(built.districts, _DISTRICTS, "ord"), "terrain": _rows(built.terrain, _TERRAIN, "ord"), "markdown": model.markdown(built, options),
            "chunks": _rows(chunks, _CHUNKS, "ord") if chunks is not None else [], "manifest": model.manifest(built, chunks) if chunks is not None else "",
        },
        ensure_ascii=False,
    )


def from_json(spark: SparkSession, text: str) -> model.Model:
    """The tables of a model's JSON; what is absent is empty."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("could not parse the model")

    def table(key: str, names: dict[str, str], ddl: str, numbered: str) -> DataFrame:
        back = {v: k for k, v in names.items()}
        rows = [json.dumps({back[k]: v for k, v in row.items() if k in back} | {numbered: i}) for i, row in enumerate(data.get(key) or [], 1)]
        return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", f"{numbered} long, {ddl}").alias("r")).select("r.*")

    promoted = table("features", _PROMOTED, "token string, name string, category string, importance int, tier string, street string, street_approx boolean, district string, lon double, lat double", "rank").withColumn("street_approx", F.coalesce("street_approx", F.lit(False)))
    minors = table("minors", _MINORS, "name string, category string, named boolean, district string, lon double, lat double", "pos")
    ranks = promoted.select("token", "rank")
    edges = table("edges", _EDGES, "from_token string, to_token string, to_name string, meters int, dir string, bucket string, crosses string, separated_by_water boolean", "ord")
    edges = edges.join(ranks.select(F.col("token").alias("from_token"), F.col("rank").alias("src")), "from_token").join(ranks.select(F.col("token").alias("to_token"), F.col("rank").alias("dst")), "to_token").withColumn("separated_by_water", F.coalesce("separated_by_water", F.lit(False)))
    districts = table("districts", _DISTRICTS, "name string, street string, spine_dir string, spine_tokens array<string>, promoted_count long, clustered_count long, named_minors array<struct<name:string,count:bigint>>, prop_count long, anchor_lon double, anchor_lat double", "ord")
    terrain = table("terrain", _TERRAIN, "name string, kind string, kind_label string, note string, position string, geometry_type string, parts array<array<array<double>>>", "ord")
    points = F.transform("parts", lambda part: F.transform(part, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    terrain = terrain.withColumn("parts", points)
    terrain = terrain.withColumn("area_m2", F.when(F.col("geometry_type") == "Polygon", F.aggregate("parts", F.lit(0.0), lambda s, ring: s + geo.ring_area_m2(ring))).otherwise(F.lit(0.0)))
    meta = spark.createDataFrame([(data.get("title") or "", [float(x) for x in data.get("bounds") or []])], "title string, bounds array<double>")
    return model.Model(meta, promoted, minors, edges, districts, terrain)


def _guarded(f) -> str:
    """What f gives, or the error as JSON; every action has run by then."""
    try:
        return f()
    except Exception as error:  # noqa: BLE001
        return json.dumps({"error": str(error)}, ensure_ascii=False)


def from_osm(spark: SparkSession, path: str, options_json: str | None = None) -> str:
    def run() -> str:
        options = knobs.parse(options_json)
        return to_json(model.build(*normalize.from_osm(spark, path), options), options)

    return _guarded(run)


def from_geojson(spark: SparkSession, text: str, options_json: str | None = None) -> str:
    def run() -> str:
        options, collections = knobs.parse(options_json), geojson.parse(spark, text)
        return to_json(model.build(geojson.features(collections), geojson.meta(collections), options), options)

    return _guarded(run)


def render_from_model(spark: SparkSession, model_json: str, options_json: str | None = None) -> str:
    """The same model with its text, chunks and manifest made again; nothing else is rebuilt."""

    def run() -> str:
        options = knobs.parse(options_json)
        return to_json(from_json(spark, model_json), options)

    return _guarded(run)
