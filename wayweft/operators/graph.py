"""The proximity graph and what lies across its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import geo, text
from ..options import Options
from .nearest import nearest_k

#: What rounding may move, in cells.
SLACK = 1e-6


def knn_pairs(points: DataFrame, k: int) -> DataFrame:
    """points(rank, lon, lat): src, dst in both directions for each chosen neighbour, each pair once."""
    chosen = nearest_k(points.select(F.col("rank").alias("id"), "lon", "lat"), points.select(F.col("rank").alias("ord"), "lon", "lat"), k, other_than_self=True)
    return chosen.select(F.col("id").alias("src"), F.col("ord").alias("dst")).union(chosen.select(F.col("ord").alias("src"), F.col("id").alias("dst"))).distinct()


def with_ends(pairs: DataFrame, points: DataFrame) -> DataFrame:
    src = points.select(F.col("rank").alias("src"), F.col("token").alias("from_token"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    dst = points.select(F.col("rank").alias("dst"), F.col("token").alias("to_token"), F.col("name").alias("to_name"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    return pairs.join(src, "src").join(dst, "dst")


def lines_of(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Barrier segments with their label, and water segments: (ax, ay, bx, by) of each."""
    barriers = features.where("kind = 'barrier' and size(pts) >= 2")
    named = barriers.where("barrier_class is distinct from 'water'").select(text.name_of("name", "category").alias("label"), F.explode(geo.edges_of(F.col("pts"), closed=False)).alias("e"))
    water = features.where("kind = 'water'")
    rings = water.where("geom_type = 'Polygon' and size(pts) >= 3").select(F.explode(geo.edges_of(F.col("pts"))).alias("e"))
    shores = water.where("geom_type <> 'Polygon' and size(pts) >= 2").unionByName(barriers.where("barrier_class = 'water'")).select(F.explode(geo.edges_of(F.col("pts"), closed=False)).alias("e"))
    flat = lambda rows, *more: rows.select(*more, F.col("e.p.lon").alias("cx"), F.col("e.p.lat").alias("cy"), F.col("e.q.lon").alias("dx"), F.col("e.q.lat").alias("dy"))
    return flat(named, "label"), flat(rings.union(shores))


def in_cells(rows: DataFrame, x1: str, y1: str, x2: str, y2: str, cell: float) -> DataFrame:
    """rows for each grid cell (gx, gy) that the segment touches, once: in every row the columns between where it enters
    and leaves the row."""
    at = lambda v, slack: F.floor(v / cell + slack).cast("int")
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    rising = F.nullif(F.col(y2) - F.col(y1), F.lit(0.0))
    x_at = lambda y: F.col(x1) + (F.col(x2) - F.col(x1)) * (F.least(F.greatest(y * cell, low), high) - F.col(y1)) / rising
    one, two = F.coalesce(x_at(F.col("gy") - SLACK), x1), F.coalesce(x_at(F.col("gy") + 1 + SLACK), x2)
    across = rows.withColumn("gy", F.explode(F.sequence(at(low, -SLACK), at(high, SLACK))))
    return across.withColumn("gx", F.explode(F.sequence(at(F.least(one, two), -SLACK), at(F.greatest(one, two), SLACK)))).select(*rows.columns, "gx", "gy")


def crossed_labels(ends: DataFrame, barriers: DataFrame, cell: float = 0.005) -> DataFrame:
    """src, dst and the smallest label of the barriers that the straight line crosses."""
    met = in_cells(ends.select("src", "dst", "ax", "ay", "bx", "by"), "ax", "ay", "bx", "by", cell).join(in_cells(barriers, "cx", "cy", "dx", "dy", cell), ["gx", "gy"])
    return met.where(geo.segments_cross("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")).groupBy("src", "dst").agg(F.min("label").alias("crosses"))


def water_crossings(ends: DataFrame, features: DataFrame, water_edges: DataFrame, cell: float = 0.005) -> DataFrame:
    """src, dst of the lines that meet water: an edge or shore crossed, or an end inside a water ring."""
    crossing = in_cells(ends.select("src", "dst", "ax", "ay", "bx", "by"), "ax", "ay", "bx", "by", cell).join(in_cells(water_edges, "cx", "cy", "dx", "dy", cell), ["gx", "gy"]).where(geo.segments_cross("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")).select("src", "dst")
    wet = points_in_rings(ends.select(F.col("src").alias("rank"), F.col("ax").alias("lon"), F.col("ay").alias("lat")).distinct(), features.where("kind = 'water' and geom_type = 'Polygon' and size(pts) >= 3"), cell)
    inside = ends.join(wet.withColumnRenamed("rank", "src"), "src", "left_semi").select("src", "dst").union(ends.join(wet.withColumnRenamed("rank", "dst"), "dst", "left_semi").select("src", "dst"))
    return crossing.union(inside).distinct()


#: Runs of cells inside a ring are cut to powers of this many columns; a world of cells has no longer runs.
RUN, RUN_LEVELS = 8, 6


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float = 0.005) -> DataFrame:
    """rank of the points(rank, lon, lat) inside a ring (even-odd, a point on an edge as the ray to its east decides).

    Every ring labels the cells of each row from the east: those its edges touch, and between them runs of cells wholly
    inside. A point in such a run needs no edge. One beside an edge starts from the place on its row's lower line straight
    below or above: the crossings of that line in columns farther east come as one number, those of the own cell one by
    one, and every edge of the cell between the point and that place turns the answer. So a point meets its own cell's
    edges alone, however long the shore and its row are.
    """
    band = lambda v: F.floor(v / cell).cast("int")
    east_of = lambda lat: (F.col("jx") - F.col("ix")) * (lat - F.col("iy")) / F.nullif(F.col("jy") - F.col("iy"), F.lit(0.0)) + F.col("ix")
    line = F.col("gy") * F.lit(cell)
    shores = rings.select(F.col("pos").alias("ring"), F.explode(geo.edges_of(F.col("pts"))).alias("e")).select("ring", F.col("e.q.lon").alias("ix"), F.col("e.q.lat").alias("iy"), F.col("e.p.lon").alias("jx"), F.col("e.p.lat").alias("jy"))
    touched = in_cells(shores, "ix", "iy", "jx", "jy", cell)
    rows = F.sequence(band(F.least("iy", "jy")), band(F.greatest("iy", "jy")) + 1)
    met_lines = shores.where("iy <> jy").withColumn("gy", F.explode(rows)).where((F.col("iy") > line) != (F.col("jy") > line)).withColumn("gx", band(east_of(line)))
    keys = ["ring", "gy", "gx"]
    cells = touched.select(*keys, F.lit(0).alias("n")).union(met_lines.select(*keys, F.lit(1).alias("n"))).groupBy(keys).agg(F.sum("n").alias("n"))
    eastward = Window.partitionBy("ring", "gy").orderBy(F.desc("gx"))
    cells = cells.select(*keys, "n", (F.sum("n").over(eastward) - F.col("n")).alias("beyond"), F.lag("gx").over(eastward).alias("next"))
    runs = cells.where("next > gx + 1 and beyond % 2 = 1").select("gy", (F.col("gx") + 1).alias("low"), (F.col("next") - 1).alias("high"))
    inside = _in_runs(points.select("rank", band(F.col("lat")).alias("gy"), band(F.col("lon")).alias("gx")), runs)
    # what a point by an edge adds up: the lines beyond, the lines of its cell to its east, the edges on its way
    ends = ["ix", "iy", "jx", "jy"]
    void = [F.lit(None).cast("double").alias(e) for e in ends]
    items = cells.select(*keys, F.lit(0).alias("item"), "beyond", *void).union(met_lines.select(*keys, F.lit(1), F.lit(0), *ends)).union(touched.select(*keys, F.lit(2), F.lit(0), *ends))
    lon, lat = F.col("lon"), F.col("lat")
    level = F.col("iy") == F.col("jy")
    parted = F.when(level, (F.col("iy") > line) != (F.col("iy") > lat)).otherwise((lon < east_of(line)) != (lon < east_of(lat)))
    turns = ((F.col("ix") > lon) != (F.col("jx") > lon)) & parted
    adds = F.when(F.col("item") == 0, F.col("beyond")).when(F.col("item") == 1, (lon < east_of(line)).cast("long")).otherwise(turns.cast("long"))
    near = points.withColumn("gy", band(lat)).withColumn("gx", band(lon)).join(items, ["gx", "gy"])
    return inside.union(near.groupBy("rank", "ring").agg(F.sum(adds).alias("n")).where("n % 2 = 1").select("rank")).distinct()


def _in_runs(at: DataFrame, runs: DataFrame) -> DataFrame:
    """rank of at(rank, gy, gx) in one of runs(gy, low, high): runs are cut to aligned pieces of powers of RUN columns, and
    a column lies in one piece of each size."""
    sizes = F.explode(F.sequence(F.lit(0), F.lit(RUN_LEVELS - 1))).alias("size")
    width = F.pow(F.lit(float(RUN)), "size")
    # the widest pieces that fit stay whole, and what they leave on both sides is cut to the next smaller ones
    fits = lambda w: (F.ceil(F.col("low") / w), F.floor((F.col("high") + 1) / w))
    cut = runs.select("gy", "low", "high", sizes)
    cut = cut.select("gy", "size", *[c.alias(name) for c, name in zip((*fits(width), *fits(width * RUN)), ("first", "past", "up", "down"))])
    some = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = (F.col("size") == RUN_LEVELS - 1) | (F.col("up") > F.col("down"))
    sides = F.concat(some(F.col("first"), F.col("up") * RUN), some(F.col("down") * RUN, F.col("past")))
    pieces = cut.select("gy", "size", F.explode(F.when(whole, some(F.col("first"), F.col("past"))).otherwise(sides)).alias("piece")).distinct()
    asked = at.select("rank", "gy", "gx", sizes).withColumn("piece", F.floor(F.col("gx") / width))
    return asked.join(pieces, ["gy", "size", "piece"], "left_semi").select("rank")


def edges(points: DataFrame, features: DataFrame, options: Options) -> DataFrame:
    """The model's edges in both directions; ord numbers those of one feature by distance, then target.

    points: a written table. What several plans read is written once, and so is the result: one plan of everything would
    be made anew with every exchange that ends, in the driver."""
    ends = tables.materialise(with_ends(knn_pairs(points, options.neighbours), points), "graph-ends")
    barriers, water = lines_of(features)
    metres = geo.haversine_m("ax", "ay", "bx", "by")
    order = Window.partitionBy("src").orderBy("exact", "dst")
    crossed = tables.materialise(crossed_labels(ends, barriers), "graph-crossed")
    wet = tables.materialise(water_crossings(ends, features, water), "graph-wet").withColumn("wet", F.lit(True))
    rows = ends.join(crossed, ["src", "dst"], "left").join(wet, ["src", "dst"], "left").withColumn("exact", metres)
    rows = rows.withColumn("ord", F.row_number().over(order)).select(
        "src", "dst", "ord", "from_token", "to_token", "to_name", geo.round_m("exact").alias("meters"), geo.eight_wind("ax", "ay", "bx", "by").alias("dir"),
        geo.bucket("exact", options.adjacent_m, options.near_m, options.short_walk_m).alias("bucket"), "crosses", F.coalesce("wet", F.lit(False)).alias("separated_by_water"),
    )
    return tables.materialise(rows, "graph-edges")


def one_way(edge_rows: DataFrame) -> DataFrame:
    """Each undirected pair once, under the smaller rank."""
    return edge_rows.where("src < dst")


def stands_apart(edge_rows: DataFrame) -> DataFrame:
    """src of the features whose every edge is across water."""
    return edge_rows.groupBy("src").agg(F.bool_and("separated_by_water").alias("apart")).where("apart").select("src")
