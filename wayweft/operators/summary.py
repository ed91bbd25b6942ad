"""District and terrain summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..options import Options
from .promote import numbered


def dominant(rows: DataFrame, key: str, street: str = "street") -> DataFrame:
    """key and its most frequent street; ties go to the first by name; keys without a street are absent."""
    counts = rows.where(text.empty_to_null(street).isNotNull()).groupBy(key, street).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(street, F.struct(-F.col("n"), F.col(street))).alias("dominant_street"))


def cluster_split(minors: DataFrame, key: str) -> DataFrame:
    """key, total, props and named: the named minors, one for each name in any case, under its first spelling, in order."""
    base = minors.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("named")).alias("props"))
    spelt = minors.where("named").groupBy(key, F.upper("name").alias("_upper")).agg(F.min_by("name", "pos").alias("name"), F.count(F.lit(1)).alias("count"))
    named = spelt.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "count"))).alias("named"))
    return base.join(named, key, "left").withColumn("named", F.coalesce("named", F.array().cast("array<struct<name:string,count:bigint>>")))


def axes(points: DataFrame, key: str) -> DataFrame:
    """key, n, centre and main axis of points(lon, lat)."""
    centre = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("lon").alias("clon"), F.avg("lat").alias("clat"))
    x = (F.col("lon") - F.col("clon")) * geo.METRES_PER_LON * F.cos(F.radians("clat"))
    y = (F.col("lat") - F.col("clat")) * geo.METRES_PER_LAT
    sums = points.join(centre, key).groupBy(key).agg(F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    out = centre.join(sums, key).withColumn("axis", geo.axis_angle("sxx", "syy", "sxy"))
    return out.withColumn("direction", F.when(F.col("n") <= 1, "N–S").otherwise(geo.axis_label("axis.ux", "axis.uy")))


def spine(points: DataFrame, cap: int) -> DataFrame:
    """district, direction and spine_tokens: the most important points(rank, token, district, importance) along the axis."""
    axis = axes(points, "district")
    first = Window.partitionBy("district").orderBy(F.desc("importance"), "rank")
    along = (F.col("lon") - F.col("clon")) * geo.METRES_PER_LON * F.cos(F.radians("clat")) * F.col("axis.ux") + (F.col("lat") - F.col("clat")) * geo.METRES_PER_LAT * F.col("axis.uy")
    keys = points.withColumn("_key", F.row_number().over(first)).where(F.col("_key") <= cap).join(axis, "district").withColumn("_along", F.when(F.col("n") <= 1, 0.0).otherwise(along))
    tokens = keys.groupBy("district").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_along")).alias("a"), "rank", "token"))), lambda t: t["token"]).alias("spine_tokens"))
    return axis.select("district", F.col("direction").alias("spine_dir")).join(tokens, "district")


def districts(points: DataFrame, minors: DataFrame, anchor_rows: DataFrame, options: Options) -> DataFrame:
    """One row per district that has a promoted feature; ord is by their number, then name."""
    sizes = points.where("district is not null").groupBy("district").agg(F.count(F.lit(1)).alias("promoted_count"))
    split = cluster_split(minors.where("district is not null"), "district")
    first = anchor_rows.groupBy(F.col("name").alias("district")).agg(F.min_by(F.struct("lon", "lat"), "pos").alias("anchor"))
    rows = sizes.join(spine(points.where("district is not null"), options.spine_cap), "district").join(dominant(points, "district"), "district", "left").join(split, "district", "left").join(first, "district")
    return numbered(rows, [F.desc("promoted_count"), F.asc("district")], "ord").select(
        F.col("ord").cast("int").alias("ord"), F.col("district").alias("name"), F.col("dominant_street").alias("street"), "spine_dir", "spine_tokens", "promoted_count", F.coalesce("total", F.lit(0)).alias("clustered_count"),
        F.coalesce("named", F.array().cast("array<struct<name:string,count:bigint>>")).alias("named_minors"), F.coalesce("props", F.lit(0)).alias("prop_count"), F.col("anchor.lon").alias("anchor_lon"), F.col("anchor.lat").alias("anchor_lat"),
    )


# Fixed values of the terrain section.
KIND_ORDER = ("water", "park", "barrier")
NOTES = {"water": "open water", "park": "green space", "barrier": "impassable except at crossings"}


def terrain(features: DataFrame, bounds: Column) -> DataFrame:
    """One row per kind and name: label, note, position and parts. The first member decides the geometry type; members of
    another type are dropped, and so are groups without a vertex. bounds: an array column or literal."""
    rows = features.where(F.col("kind").isin(*KIND_ORDER)).withColumn("name", text.name_of("name", "category"))
    groups = rows.groupBy("kind", "name").agg(F.min_by(F.struct("geom_type", "barrier_class"), "pos").alias("head"), F.array_sort(F.collect_list(F.struct("pos", "geom_type", "pts"))).alias("members"))
    linear = F.col("head.geom_type") == "LineString"
    wanted = F.when(linear, "LineString").otherwise("Polygon")
    groups = groups.withColumn("linear", linear).withColumn("parts", F.transform(F.filter("members", lambda m: (m["geom_type"] == wanted) & (F.size(m["pts"]) > 0)), lambda m: m["pts"]))
    groups = groups.withColumn("flat", F.flatten("parts")).where(F.size("flat") > 0)
    note = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])[F.col("kind")]
    area = F.when(F.col("linear"), F.lit(0.0)).otherwise(F.aggregate("parts", F.lit(0.0), lambda s, ring: s + geo.ring_area_m2(ring)))
    kind_order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    return numbered(groups, [kind_order, F.asc("name")], "ord").select(
        F.col("ord").cast("int").alias("ord"), "name", "kind", F.when(F.col("kind") == "barrier", F.concat(F.lit("barrier:"), F.coalesce("head.barrier_class", F.lit("")))).otherwise(F.col("kind")).alias("kind_label"), note.alias("note"),
        geo.position_in(F.col("flat"), bounds, F.col("linear")).alias("position"), F.when(F.col("linear"), "LineString").otherwise("Polygon").alias("geometry_type"), "parts", area.alias("area_m2"),
    )


def shown(terrain_rows: DataFrame, least_m2: float) -> DataFrame:
    """Without the small polygons of water and park."""
    return terrain_rows.where(~(F.col("kind").isin("water", "park") & (F.col("geometry_type") == "Polygon") & (F.col("area_m2") < least_m2)))
