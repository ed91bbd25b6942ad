"""GeoJSON scan and decoding of the contract between the two stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.geo import point
from ..functions.text import is_blank


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per collection: title, bounds and features; coordinates stay JSON text. Names match in any case."""
    return spark.read.option("multiLine", True).schema(schema.GEOJSON).json(path)


def parse(spark: SparkSession, text: str) -> DataFrame:
    """The same from a string; JSON null gives an empty collection."""
    row = spark.range(1).select(F.from_json(F.lit(text), schema.GEOJSON, {"mode": "FAILFAST"}).alias("fc"))
    return row.select("fc.*")


def point_of(coordinates: Column) -> Column:
    """The point as a one-element array; an unreadable one is an error."""
    values = F.from_json(coordinates, "array<double>")
    ok = values.isNotNull() & (F.size(values) >= 2) & F.get(values, F.lit(0)).isNotNull() & F.get(values, F.lit(1)).isNotNull()
    return F.when(ok, F.array(point(F.get(values, F.lit(0)), F.get(values, F.lit(1))))).otherwise(F.raise_error(F.concat(F.lit("unreadable point: "), F.coalesce(coordinates, F.lit("null")))).cast(schema.POINTS))


def _positions(values: Column) -> Column:
    return F.transform(F.filter(values, lambda p: F.size(p) >= 2), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def line_of(coordinates: Column) -> Column:
    return F.coalesce(_positions(F.from_json(coordinates, "array<array<double>>")), F.array().cast(schema.POINTS))


def outer_ring_of(coordinates: Column) -> Column:
    """The first ring; inner rings are dropped."""
    return F.coalesce(_positions(F.get(F.from_json(coordinates, "array<array<array<double>>>"), F.lit(0))), F.array().cast(schema.POINTS))


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features and meta of a folder that writers.write_lines() wrote, or of newline-delimited features: files of any
    size, split as Spark likes. The order is that of the file parts and their lines."""
    kind = schema.GEOJSON
    feature = kind[kind.index("array<struct<") + len("array<") : kind.rindex(">")]
    rows = spark.read.text(f"{path}/features").select(F.monotonically_increasing_id().alias("at"), F.from_json("value", feature, {"mode": "FAILFAST"}).alias("f"))
    head = spark.read.text(f"{path}/collection").select(F.from_json("value", "schemaVersion int, title string, bounds array<double>").alias("properties"))
    return flat(rows), meta(head)


def features(collections: DataFrame) -> DataFrame:
    """The features in their order, flat and with their geometry decoded."""
    return flat(collections.select(F.posexplode("features").alias("at", "f")))


def flat(rows: DataFrame) -> DataFrame:
    """rows(at, f): a feature each."""
    p, g = F.col("f.properties"), F.col("f.geometry")
    pts = F.when(g["type"] == "Point", point_of(g["coordinates"])).when(g["type"] == "LineString", line_of(g["coordinates"])).when(g["type"] == "Polygon", outer_ring_of(g["coordinates"])).otherwise(F.array().cast(schema.POINTS))
    return rows.select(
        F.col("at").cast("long").alias("pos"), p["kind"].alias("kind"), p["name"].alias("name"), p["osmId"].alias("osm_id"), p["category"].alias("category"), p["importance"].alias("importance"), p["tier"].alias("tier"),
        p["salience"].alias("salience"), p["street"].alias("street"), p["streetApprox"].alias("street_approx"), p["barrierClass"].alias("barrier_class"), g["type"].alias("geom_type"), pts.alias("pts"),
    )


def meta(collections: DataFrame) -> DataFrame:
    """title (a blank one gets a stand-in) and bounds, of four numbers or none; missing bounds are four zeros."""
    title, bounds = F.col("properties.title"), F.col("properties.bounds")
    return collections.select(F.when(is_blank(title), "Untitled area").otherwise(title).alias("title"), F.when(bounds.isNull(), F.array(*[F.lit(0.0)] * 4)).when(F.size(bounds) == 4, bounds).otherwise(F.array().cast("array<double>")).alias("bounds"))
