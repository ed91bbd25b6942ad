"""A deterministic geography over the star-schema tables, so that every operator has an oracle.

Nations are the cells of a 5 x 5 lattice, each with a place in its middle, a barrier, a park and, in every other
cell, a lake. Customers and suppliers are points of interest; orders are ways whose nodes are parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import point
from ..operators.classify import importance_of, salience_of, settled, tier_of

#: Subclasses of each market segment's class, by the key modulo four.
SEGMENTS = {
    "AUTOMOBILE": ("shop", ("books", "bakery", "tailor", "florist")),
    "BUILDING": ("residential", ("house", "apartments", "terrace", "bungalow")),
    "FURNITURE": ("leisure", ("marina", "garden", "stadium", "pitch")),
    "HOUSEHOLD": ("food", ("cafe", "bar", "pub", "restaurant")),
    "MACHINERY": ("landmark", ("church", "artwork", "museum", "tower")),
}
CIVIC = ("civic", ("school", "dentist", "government", "library"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(rows: DataFrame) -> DataFrame:
    key, nation = F.col("key"), F.col("nation")
    lon = F.lit(-120.5) + (nation % 5) * F.lit(0.01) + ((key * 37) % 997) * F.lit(0.00001)
    lat = F.lit(45.5) + F.floor(nation / 5).cast("int") * F.lit(0.01) + ((key * 91) % 991) * F.lit(0.00001)
    return rows.withColumn("lon", lon).withColumn("lat", lat)


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, osm_id, name, category, importance, tier, salience, street, street_approx, lon, lat and the parts they come from."""
    chosen = F.lit(None).cast("string")
    for segment, (name, subs) in SEGMENTS.items():
        chosen = F.when(F.col("segment") == segment, F.concat(F.lit(f"{name}."), F.element_at(F.array(*[F.lit(s) for s in subs]), (F.col("key") % 4 + 1).cast("int")))).otherwise(chosen)
    one = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_custkey").alias("key"), F.concat(F.lit("n"), "c_custkey").alias("osm_id"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    two = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_suppkey").alias("key"), F.concat(F.lit("s"), "s_suppkey").alias("osm_id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("nation"), F.lit("CIVIC").alias("segment"))
    rows = _place(one.union(two))
    civic = F.concat(F.lit("civic."), F.element_at(F.array(*[F.lit(s) for s in CIVIC[1]]), (F.col("key") % 4 + 1).cast("int")))
    rows = settled(rows, F.when(F.col("segment") == "CIVIC", civic).otherwise(chosen), "category").withColumn("name", F.when(F.col("key") % 7 != 0, F.col("label")))
    rows = settled(rows, importance_of("category", F.col("name").isNotNull(), F.col("key") % 11 == 0), "importance").withColumn("tier", tier_of("importance")).withColumn("salience", F.when(F.col("key") % 2 == 0, salience_of("category")))
    return rows.withColumn("street", F.when(F.col("key") % 9 != 0, F.concat(F.lit("Street "), (F.col("key") % 40).cast("string")))).withColumn("street_approx", F.when(F.col("key") % 3 == 0, F.lit(True)))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("pos"), F.col("n_name").alias("name"), (F.lit(-120.495) + (n % 5) * F.lit(0.01)).alias("lon"), (F.lit(45.505) + F.floor(n / 5).cast("int") * F.lit(0.01)).alias("lat"))


def _box(lon, lat, half):
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    return F.array(*[point(lon + F.lit(float(x)) * half, lat + F.lit(float(y)) * half) for x, y in corners])


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, kind, name, geom_type, barrier_class and pts of barriers, lakes and parks."""
    rows = places(spark, sf_dir)
    n, lon, lat = F.col("pos"), F.col("lon"), F.col("lat")
    cls = F.when(n % 3 == 0, "motorway").when(n % 3 == 1, "rail").otherwise("water")
    bend = F.array(point(lon - 0.004, lat - 0.004), point(lon, lat + 0.001), point(lon + 0.004, lat + 0.002))
    barrier = rows.select((n + 100).alias("pos"), F.lit("barrier").alias("kind"), F.concat(F.lit("Route "), (n % 7).cast("string")).alias("name"), F.lit("LineString").alias("geom_type"), cls.alias("barrier_class"), bend.alias("pts"))
    lake = rows.where("pos % 2 = 0").select((n + 200).alias("pos"), F.lit("water").alias("kind"), F.concat(F.lit("Lake "), (n % 4).cast("string")).alias("name"), F.lit("Polygon").alias("geom_type"), F.lit(None).cast("string").alias("barrier_class"), _box(lon + 0.001, lat + 0.001, F.lit(0.0015)).alias("pts"))
    park = rows.select((n + 300).alias("pos"), F.lit("park").alias("kind"), F.concat(F.lit("Park "), n.cast("string")).alias("name"), F.lit("Polygon").alias("geom_type"), F.lit(None).cast("string").alias("barrier_class"), _box(lon - 0.002, lat, F.lit(0.0001) + F.lit(0.0002) * (n % 4)).alias("pts"))
    return barrier.union(lake).union(park)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of it as the contract table."""
    void = lambda kind: F.lit(None).cast(kind)
    poi = pois(spark, sf_dir).select((F.col("id") + 1000).alias("pos"), F.lit("poi").alias("kind"), "name", "osm_id", "category", "importance", "tier", "salience", "street", "street_approx", void("string").alias("barrier_class"), F.lit("Point").alias("geom_type"), F.array(point("lon", "lat")).alias("pts"))
    place = places(spark, sf_dir).select("pos", F.lit("place").alias("kind"), "name", F.concat(F.lit("p"), "pos").alias("osm_id"), F.lit("Point").alias("geom_type"), F.array(point("lon", "lat")).alias("pts"))
    shape = shapes(spark, sf_dir).withColumn("osm_id", F.concat(F.lit("w"), "pos"))
    return poi.unionByName(place, allowMissingColumns=True).unionByName(shape, allowMissingColumns=True)


def bounds():
    return F.array(*[F.lit(x) for x in (-120.5, 45.5, -120.45, 45.55)])


def meta(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("Lattice").alias("title"), bounds().alias("bounds"))


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, node and the order keys of its vertices."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("node"), node_lon(key).alias("lon"), node_lat(key).alias("lat")).where(key % 13 != 0)


def node_lon(key):
    """A lattice, off by a little, so that no two roads are equally far from a third point."""
    return F.lit(-120.5) + (key % 97) * F.lit(0.0003) + ((key * key * 31 + key) % 1009) * F.lit(0.0000001)


def node_lat(key):
    return F.lit(45.5) + (key % 89) * F.lit(0.0003) + ((key * key * 17 + key) % 997) * F.lit(0.0000001)
