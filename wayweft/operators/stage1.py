"""From tagged nodes, ways and relations to contract features."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .. import schema, tables
from ..functions import geo, text
from ..sources.osm import last_by_id, node_points
from . import classify, kernels, lines, streets
from .promote import numbered

# Fixed values of the normalization.
STREET_RADIUS_M, MERGE_RADIUS_M, TOLERANCE_DEG = 30.0, 40.0, 0.000045
METRES_PER_DEGREE = 110_000.0


def way_points(refs: DataFrame, points: DataFrame) -> DataFrame:
    """refs(key, nds) with the points of their nodes in order; nodes that are not there are left out."""
    steps = refs.select("key", F.posexplode("nds").alias("at", "id"))
    met = steps.join(points, "id").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pt"))), lambda s: s["pt"]).alias("pts"))
    return refs.drop("nds").join(met, "key", "left").withColumn("pts", F.coalesce("pts", F.array().cast(schema.POINTS)))


def roads(ways: DataFrame) -> DataFrame:
    """ways(pos, tags, pts): segments of the named roads, with their order: road, at, name and the two ends."""
    named = ways.where("map_contains_key(tags, 'highway') and map_contains_key(tags, 'name') and size(pts) >= 2")
    return named.select(F.col("pos").alias("road"), F.col("tags")["name"].alias("street"), F.posexplode(geo.edges_of(F.col("pts"), closed=False)).alias("at", "e")).select("road", "at", "street", F.col("e.p.lon").alias("x1"), F.col("e.p.lat").alias("y1"), F.col("e.q.lon").alias("x2"), F.col("e.q.lat").alias("y2"))


#: Metres of a tile of the street join. In a tile, points of a block; segments of a block while there are few blocks, how many
#: blocks are few, and segments of a block where there are more. What rounding may move, in tiles.
TILE, POINTS, FEWER, FEW_BLOCKS, SEGMENTS, SLACK = 2000.0, 20_000, 50_000, 16, 400_000, 0.01


def _row(lat, cell: float) -> Column:
    return F.floor(geo.c(lat) * METRES_PER_DEGREE / cell).cast("long")


def _across(lon, row: Column, cell: float) -> Column:
    """Longitude in cells of a row, which are at least as wide as high everywhere in the row."""
    widest = F.least(F.lit(89.0), (F.abs(row) + 2) * cell / METRES_PER_DEGREE)
    return geo.c(lon) * METRES_PER_DEGREE * F.cos(F.radians(widest)) / cell


def _columns(low, high, row: Column, cell: float, reach=0.0) -> Column:
    return F.sequence(F.floor(_across(low, row, cell) - reach - SLACK).cast("long"), F.floor(_across(high, row, cell) + reach + SLACK).cast("long"))


def _crossed(segments: DataFrame, cell: float) -> DataFrame:
    """segments with each cell (gx, gy) that they cross: for every row the columns between where they enter and leave it."""
    degrees = cell / METRES_PER_DEGREE
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = segments.withColumn("gy", F.explode(F.sequence(_row(low - SLACK * degrees, cell), _row(high + SLACK * degrees, cell))))
    at = lambda edge: F.col("x1") + (F.col("x2") - F.col("x1")) * F.coalesce((F.least(F.greatest(edge * degrees, low), high) - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)), F.lit(0.0))
    level = F.col("y1") == F.col("y2")
    enter, leave = at(F.col("gy") - SLACK), at(F.col("gy") + 1 + SLACK)
    west = F.when(level, F.least("x1", "x2")).otherwise(F.least(enter, leave))
    east = F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(enter, leave))
    return rows.withColumn("gx", F.explode(_columns(west, east, F.col("gy"), cell)))


def _candidates(radius: float):
    def run(key, points, segments):
        columns = lambda table, names: [table.column(n).to_numpy() for n in names]
        p, s = streets.candidates(*columns(points, ("lon", "lat")), np.column_stack(columns(segments, _ENDS)), radius)
        return pa.Table.from_arrays([*(points.column(n).take(pa.array(p)) for n in ("id", "lon", "lat")), *(segments.column(n).take(pa.array(s)) for n in _SEGMENT)], names=["id", "lon", "lat", *_SEGMENT])

    return run


_ENDS = ["x1", "y1", "x2", "y2"]
_SEGMENT = ["road", "at", "street", *_ENDS]


def nearest_street(pois: DataFrame, segments: DataFrame, radius: float = STREET_RADIUS_M) -> DataFrame:
    """id and street of the nearest segment of pois(id, lon, lat) within the radius; the first in the file wins a tie.

    Segments go to the tiles that they cross, pois to those within the radius of them. What meets in a tile is dealt to
    blocks, each of some points and some segments, where a kernel finds the segments that can be nearest (streets.py); so
    a task's tables are bounded however dense a tile is. The distances that decide are those of geo.point_segment_m.
    """
    segments = tables.materialise(segments.select(_SEGMENT).dropna(subset=_ENDS), "street-segments")
    asking = pois.select("id", "lon", "lat").dropna(subset=["lon", "lat"])
    step = radius / METRES_PER_DEGREE + SLACK * TILE / METRES_PER_DEGREE
    asking = asking.withColumn("gy", F.explode(F.sequence(_row(F.col("lat") - step, TILE), _row(F.col("lat") + step, TILE))))
    asking = tables.materialise(asking.withColumn("gx", F.explode(_columns("lon", "lon", F.col("gy"), TILE, radius / TILE))), "street-points")
    crossed = _crossed(segments, TILE)
    tile = ["gx", "gy"]
    n = F.count(F.lit(1))
    blocks = asking.groupBy(tile).agg(F.ceil(n / POINTS).alias("p_blocks")).join(crossed.groupBy(tile).agg(F.greatest(F.least(F.ceil(n / FEWER), F.lit(FEW_BLOCKS)), F.ceil(n / SEGMENTS)).alias("s_blocks")), tile)
    blocks = tables.materialise(blocks, "street-blocks")
    dealt = lambda own, count, *by: F.pmod(F.xxhash64(*by), F.col(count)).alias(own)
    every = lambda other, count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(other)
    left = asking.join(blocks, tile).select("id", "lon", "lat", *tile, dealt("p_block", "p_blocks", "id", "lon", "lat"), every("s_block", "s_blocks"))
    right = crossed.join(blocks, tile).select(*_SEGMENT, *tile, dealt("s_block", "s_blocks", "road", "at"), every("p_block", "p_blocks"))
    keys = [*tile, "p_block", "s_block"]
    kinds = {**dict(pois.select("id", "lon", "lat").dtypes), **dict(segments.dtypes)}
    near = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_candidates(radius), ", ".join(f"{c} {kinds[c]}" for c in ("id", "lon", "lat", *_SEGMENT)))
    metres = geo.point_segment_m("lon", "lat", *_ENDS)
    met = near.withColumn("d", metres).where(F.col("d") <= radius)
    return met.groupBy("id").agg(F.min_by("street", F.struct("d", "road", "at")).alias("street"))


def merged(pois: DataFrame, radius: float = MERGE_RADIUS_M) -> DataFrame:
    """pois(name, importance, osm_id, category, lon, lat, ...) without co-located duplicates.

    A named row folds into a kept one of its class and name; an unnamed one into any kept named one of its class. The
    order is by importance, then id. Both tests are local, so both are joins over grid cells; which named rows are kept
    is settled in rounds, from each neighbourhood's first row on.
    """
    rows = tables.materialise(pois.withColumn("_id", F.monotonically_increasing_id()), "merge-rows")
    own = rows.where(text.empty_to_null("category").isNotNull()).select("_id", text.klass("category").alias("k"), text.empty_to_null("name").alias("name"), F.coalesce("importance", F.lit(0)).alias("imp"), "osm_id", "lon", "lat")
    named = own.where("name is not null")
    one, two = _near(named, named, radius, ["k", "name"])
    earlier = F.struct((-F.col("imp")).alias("i"), "osm_id", "_id") < F.struct((-F.col("o_imp")).alias("i"), F.col("o_osm_id").alias("osm_id"), F.col("o_id").alias("_id"))
    before = tables.materialise(one.join(two, ["k", "name", "gx", "gy"]).where(earlier & _within(radius)).select(F.col("o_id").alias("later"), F.col("_id").alias("first")).distinct(), "merge-pairs")
    gone = settled(before)
    kept_named = named.join(gone, "_id", "left_anti")
    one, two = _near(kept_named, own.where("name is null"), radius, ["k"])
    folded = one.join(two, ["k", "gx", "gy"]).where(_within(radius)).select(F.col("o_id").alias("_id")).distinct()
    return rows.join(gone.union(folded), "_id", "left_anti").drop("_id")


def _within(radius: float) -> Column:
    return geo.haversine_m("lon", "lat", "o_lon", "o_lat") <= radius


def _near(left: DataFrame, right: DataFrame, radius: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """left in its own cell, right (as o_...) in the cells within a radius of it."""
    reach = radius / METRES_PER_DEGREE
    row = lambda lat: F.floor(lat / reach).cast("long")
    squeeze = lambda r: F.cos(F.radians(F.least(F.lit(89.0), (F.abs(r) + 2) * reach)))
    col = lambda lon, r: F.floor(lon * squeeze(r) / reach).cast("long")
    one = left.withColumn("gy", row(F.col("lat"))).withColumn("gx", col(F.col("lon"), F.col("gy")))
    two = right.select(*keys, *[F.col(x).alias(f"o_{x.lstrip('_')}") for x in ("_id", "imp", "osm_id", "lon", "lat")])
    two = two.withColumn("gy", F.explode(F.sequence(row(F.col("o_lat")) - 1, row(F.col("o_lat")) + 1))).withColumn("gx", F.explode(F.sequence(col(F.col("o_lon"), F.col("gy")) - 2, col(F.col("o_lon"), F.col("gy")) + 2)))
    return one, two


def settled(before: DataFrame) -> DataFrame:
    """_id of the rows that fold: those with a kept earlier neighbour. before(later, first)."""
    gone = before.select(F.col("later").alias("_id")).limit(0)
    open_ = before
    while not open_.isEmpty():
        # a row without an open earlier neighbour is kept, and what it neighbours folds
        kept = open_.select(F.col("first").alias("_id")).distinct().join(open_.select(F.col("later").alias("_id")).distinct(), "_id", "left_anti")
        folds = tables.materialise(open_.join(kept.withColumnRenamed("_id", "first"), "first", "left_semi").select(F.col("later").alias("_id")).distinct(), "merge-folds")
        gone = gone.union(folds)
        # a folded row decides nothing, and nothing more is to decide about it
        rest = open_.join(folds.withColumnRenamed("_id", "later"), "later", "left_anti").join(folds.withColumnRenamed("_id", "first"), "first", "left_anti")
        open_ = tables.materialise(rest, "merge-open")
    return gone


_POINTS = ArrayType(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())]))


@F.pandas_udf(_POINTS)
def simplified_line(lines: pd.Series) -> pd.Series:
    """Lines within the tolerance, rounded; null for fewer than two points."""
    return lines.map(lambda pts: _records(kernels.simplify(_pairs(pts), TOLERANCE_DEG)) if pts is not None and len(pts) > 1 else None)


@F.pandas_udf(_POINTS)
def simplified_ring(rings: pd.Series) -> pd.Series:
    """Closed rings within the tolerance, rounded; null for fewer than four points."""
    return rings.map(lambda pts: _records(kernels.simplify_ring(_pairs(pts), TOLERANCE_DEG)) if pts is not None and len(pts) > 3 else None)


@F.pandas_udf(_POINTS)
def hull_of(points: pd.Series) -> pd.Series:
    """The closed convex hull, rounded; null without an area."""
    return points.map(lambda pts: _records(h) if pts is not None and (h := kernels.hull(_pairs(pts))) else None)


def hulls(rows: DataFrame, key: str) -> DataFrame:
    """key and pts, the closed hull of all points of rows(key, pts). Every row, and every task's rows of a key, give only
    their corners; keys without an area are left out."""

    def corners(batches):
        for frame in batches:
            found: dict = {}
            for k, pts in zip(frame[key], frame["pts"]):
                some = found.setdefault(k, [])
                some += _pairs(pts)
                if len(some) > 10_000:
                    found[k] = kernels.extremes(some)
            yield pd.DataFrame({key: list(found), "pts": [[{"lon": x, "lat": y} for x, y in kernels.extremes(p)] for p in found.values()]})

    kind = rows.schema[key].dataType
    own = rows.where("size(pts) > 0").select(key, "pts").mapInPandas(corners, StructType([StructField(key, kind), StructField("pts", _POINTS)]))
    return own.groupBy(key).agg(hull_of(F.flatten(F.collect_list("pts"))).alias("pts")).where("pts is not null")


def _pairs(pts) -> list[tuple[float, float]]:
    return [(p["lon"], p["lat"]) for p in pts]


def _records(line) -> list[dict]:
    return [{"lon": round(x, 7), "lat": round(y, 7)} for x, y in line]


#: Relations with more points than this in their outer ways are joined across tasks, with the same results.
TOGETHER = 100_000

_SHAPE = StructType([StructField("geom_type", StringType()), StructField("pts", _POINTS)])


@F.pandas_udf(StructType([StructField("lines", ArrayType(_POINTS))]))
def _joined(groups: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    """The joined lines of ways whose points come one after another: arrays of arrays of unlike lengths do not cross over."""
    made = []
    for pts, lengths in zip(groups, sizes):
        todo = iter(_pairs(pts))
        made.append([[{"lon": x, "lat": y} for x, y in line] for line in kernels.merge_lines([list(islice(todo, n)) for n in lengths])])
    return pd.DataFrame({"lines": made})


@F.pandas_udf(_SHAPE)
def _outline(lines: pd.Series) -> pd.DataFrame:
    found = [kernels.outline(_pairs(line), TOLERANCE_DEG) or (None, []) for line in lines]
    return pd.DataFrame({"geom_type": [kind for kind, _ in found], "pts": [[{"lon": x, "lat": y} for x, y in line] for _, line in found]})


def outlines(outer: DataFrame, together: int = TOGETHER) -> DataFrame:
    """outer(id, m_at, pts): id, n, geom_type and pts of the rings and open lines that the ways of an id make."""
    outer = tables.materialise(outer, "outer-ways")
    sizes = tables.materialise(outer.groupBy("id").agg((F.sum(F.size("pts")) > together).alias("long")), "outer-sizes")
    short = outer.join(sizes.where("not long"), "id", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m_at", "pts"))), lambda s: s["pts"]).alias("ways"))
    made = short.select("id", F.posexplode(_joined(F.flatten("ways"), F.transform("ways", lambda w: F.size(w)))["lines"]).alias("n", "line"))
    if not sizes.where("long").isEmpty():
        apart = lines.merged_lines(outer.join(sizes.where("long"), "id", "left_semi").select(F.col("id").alias("key"), F.col("m_at").alias("at"), "pts"))
        made = made.union(apart.select(F.col("key").alias("id"), "n", F.col("pts").alias("line")))
    return made.select("id", "n", _outline("line").alias("made")).where("made.geom_type is not null").select("id", "n", "made.*")


def relation_shapes(relations: DataFrame, ways: DataFrame, points: DataFrame, together: int = TOGETHER) -> DataFrame:
    """relations(id, kind, name, members): osm_id, kind, name, geom_type and pts of their rings, else shores, else hull."""
    steps = relations.select("id", F.posexplode("members").alias("m_at", "m")).select("id", "m_at", F.col("m.ref").alias("way"), F.col("m.role").alias("role"))
    parts = steps.join(ways.select(F.col("id").alias("way"), "pts"), "way")
    made = tables.materialise(outlines(parts.where("role <> 'inner' and size(pts) >= 2").select("id", "m_at", "pts"), together), "outlines")
    ring = F.col("geom_type") == "Polygon"
    own = Window.partitionBy("id")
    made = made.withColumn("ringed", F.max(ring).over(own)).withColumn("k", F.row_number().over(Window.partitionBy("id", "geom_type").orderBy("n")) - 1)
    named = relations.select("id", "kind", "name")
    osm_id = F.concat(F.lit("r"), "id", F.when(ring, "-").otherwise("-L"), "k")
    shapes = made.where(ring | ~F.col("ringed")).join(named, "id").select(osm_id.alias("osm_id"), "kind", "name", "geom_type", "pts")
    none = hulls(parts.join(made.select("id"), "id", "left_anti").select("id", "pts"), "id").join(named, "id")
    return shapes.union(none.select(F.concat(F.lit("r"), "id").alias("osm_id"), "kind", "name", F.lit("Polygon").alias("geom_type"), "pts"))


_POI = ["osm_id", "name", "category", "importance", "tier", "salience", "tags", "lon", "lat"]


def poi_rows(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """The points of interest of nodes and of ways(id, tags, pts), before streets and merging."""
    tag = classify.tags_of()
    of_nodes = classify.classified(nodes, tag).withColumn("osm_id", F.concat(F.lit("n"), "id")).select(_POI)
    hall = classify.is_campus_hall("category") & (geo.footprint_m2(F.col("pts")) > 0)
    of_ways = classify.classified(lines, tag).where("size(pts) > 0").withColumn("osm_id", F.concat(F.lit("w"), "id"))
    of_ways = of_ways.withColumn("importance", F.when(hall, F.least(F.lit(100), F.col("importance") + classify.area_bonus(geo.footprint_m2(F.col("pts"))))).otherwise(F.col("importance")))
    of_ways = of_ways.select("*", geo.representative_point(F.col("pts")).alias("pt")).select(*_POI[:-2], F.col("pt.lon").alias("lon"), F.col("pt.lat").alias("lat"))
    return of_nodes.union(of_ways)


def with_street(pois: DataFrame, segments: DataFrame) -> DataFrame:
    """pois(id, tags, lon, lat, ...) with street and street_approx: the given one, else the nearest road's."""
    given = text.blank_to_null(F.col("tags")["addr:street"])
    snapped = nearest_street(pois.where(given.isNull()), segments)
    return pois.join(snapped.withColumnRenamed("street", "_near"), "id", "left").withColumn("street", F.coalesce(given, "_near")).withColumn("street_approx", F.when(given.isNull() & F.col("_near").isNotNull(), F.lit(True))).drop("_near")


def place_rows(nodes: DataFrame) -> DataFrame:
    """Named neighbourhoods and quarters, which are the anchors of districts."""
    named = F.col("tags")["place"].isin(*classify.ANCHOR_PLACES) & F.map_contains_key("tags", F.lit("name"))
    return nodes.where(named).select(F.col("tags")["name"].alias("name"), F.concat(F.lit("n"), "id").alias("osm_id"), F.lit("Point").alias("geom_type"), F.array(geo.point(geo.round7("lon"), geo.round7("lat"))).alias("pts"))


def barrier_rows(lines: DataFrame) -> DataFrame:
    label, kind = classify.barrier_of(classify.tags_of())
    rows = lines.select(label.alias("name"), kind.alias("cls"), F.concat(F.lit("w"), "id").alias("osm_id"), F.lit("LineString").alias("geom_type"), "pts").where("cls is not null")
    return rows.withColumn("pts", simplified_line("pts")).where("pts is not null")


def area_rows(lines: DataFrame) -> DataFrame:
    """Water and parks that are closed ways."""
    rows = lines.select(classify.area_of(classify.tags_of()).alias("of"), F.col("tags")["name"].alias("name"), F.concat(F.lit("w"), "id").alias("osm_id"), F.lit("Polygon").alias("geom_type"), geo.closed_ring(F.col("pts")).alias("pts")).where("of is not null")
    return rows.withColumn("pts", simplified_ring("pts")).where("pts is not null")


def features(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """The contract table of the scans in sources.osm, in the order of osm_id and kind."""
    points = tables.materialise(node_points(nodes), "node-points")
    lines = tables.materialise(way_points(ways.withColumn("key", F.col("pos")), points).drop("key"), "way-points")
    pois = tables.materialise(poi_rows(nodes, lines).withColumn("id", F.monotonically_increasing_id()), "pois")
    pois = merged(with_street(pois, roads(lines)).withColumn("lon", geo.round7("lon")).withColumn("lat", geo.round7("lat")))
    void = lambda kind: F.lit(None).cast(kind)

    def flat(rows: DataFrame, kind, barrier_class=None) -> DataFrame:
        return rows.select(
            kind.alias("kind"), "name", "osm_id", void("string").alias("category"), void("int").alias("importance"), void("string").alias("tier"), void("string").alias("salience"), void("string").alias("street"), void("boolean").alias("street_approx"),
            (barrier_class if barrier_class is not None else void("string")).alias("barrier_class"), "geom_type", "pts",
        )

    kept = pois.select(F.lit("poi").alias("kind"), "name", "osm_id", "category", "importance", "tier", "salience", "street", "street_approx", void("string").alias("barrier_class"), F.lit("Point").alias("geom_type"), F.array(geo.point("lon", "lat")).alias("pts"))
    multi = relations.select("id", classify.area_of(classify.tags_of()).alias("kind"), F.col("tags")["name"].alias("name"), "members").where("kind is not null")
    shapes = relation_shapes(multi, last_by_id(lines.select("id", "pos", "pts")), points)
    rows = kept.unionByName(flat(place_rows(nodes), F.lit("place"))).unionByName(flat(barrier_rows(lines), F.lit("barrier"), F.col("cls"))).unionByName(flat(area_rows(lines), F.col("of"))).unionByName(flat(shapes, F.col("kind")))
    rows = tables.materialise(rows, "contract")
    return numbered(rows, [F.asc("osm_id"), F.asc("kind")], "pos")


def meta(nodes: DataFrame) -> DataFrame:
    """title and bounds: the first two names of places, in the file's order, and the box of all nodes."""
    places = nodes.where(F.col("tags")["place"].isin(*classify.TITLE_PLACES) & F.map_contains_key("tags", F.lit("name"))).select(F.col("tags")["name"].alias("name"), "pos")
    names = places.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos").limit(2).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda p: p["name"]).alias("names"))
    box = nodes.agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    bounds = F.array(*[F.coalesce(x, F.lit(0.0)) for x in ("w", "s", "e", "n")])
    return names.crossJoin(box).select(F.when(F.size("names") == 0, "Untitled area").otherwise(F.array_join("names", " & ")).alias("title"), bounds.alias("bounds"))  # one row with one row
