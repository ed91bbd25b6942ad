"""Nearest targets of points: the k closest, ties by the target's order.

A few targets (counted first) travel as one array to the points. Beyond that targets are dealt to the cells of a grid, so
fine that the fullest cell holds few (of targets at one place only the first k can count). A point looks at the nine cells about it and is done once its k-th distance is
within the cell's size. The others go on with areas three times as wide, but meet the cells in them before the targets:
a cell's box says how near its targets are at least and at most, so only targets that can be among the k are compared,
however many an area holds. Columns wrap around at the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions.geo import haversine_m

#: Targets that travel as an array; targets that the fullest cell may hold; height of the finest cells in metres.
FEW, FULL, FINEST = 200, 64, 1.0
_METRES = 111_000.0  # a degree of latitude, and a little less


def nearest_k(points: DataFrame, targets: DataFrame, k: int = 1, other_than_self: bool = False, few: int = FEW) -> DataFrame:
    """points(id, lon, lat), targets(ord, lon, lat): id, ord, dist and rank (from 1). other_than_self: ids are orders."""
    n = targets.limit(few + 1).count()
    return _from_array(points, targets, k, other_than_self) if n <= few else _from_grid(points, targets, k, other_than_self)


def _from_array(points: DataFrame, targets: DataFrame, k: int, other_than_self: bool) -> DataFrame:
    every = targets.agg(F.collect_list(F.struct("ord", F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("every"))
    ranked = F.transform("every", lambda t: F.struct(haversine_m("lon", "lat", t["x"], t["y"]).alias("dist"), t["ord"].alias("ord")))
    if other_than_self:
        ranked = F.filter(ranked, lambda t: t["ord"] != F.col("id"))
    best = F.filter(F.array(F.array_min(ranked)), lambda t: t.isNotNull()) if k == 1 else F.slice(F.array_sort(ranked), 1, k)
    found = points.crossJoin(F.broadcast(every)).select("id", F.posexplode(best).alias("at", "t"))
    return found.select("id", F.col("t.ord").alias("ord"), F.col("t.dist").alias("dist"), (F.col("at") + 1).alias("rank"))


class Grid:
    """Cells of a height in metres, and of at least that width by their row's latitude; as many columns as go around."""

    def __init__(self, size: float):
        self.size = size

    def row(self, lat) -> Column:
        return F.floor(F.col(lat) * _METRES / self.size).cast("long")

    def columns(self, row: Column) -> Column:
        """Columns of a row, wide enough for its neighbours' latitudes, too."""
        widest = F.least(F.lit(90.0), (F.abs(row + F.lit(0.5)) + 1.5) * (self.size / _METRES))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(widest)) * _METRES / self.size)).cast("long")

    def column(self, lon, row: Column) -> Column:
        n = self.columns(row)
        return F.pmod(F.floor((F.col(lon) + 180) / 360 * n).cast("long"), n)

    def around(self, lon, lat) -> Column:
        """The cells (cx, cy) within a cell's size of a place, each once."""

        def beside(row: Column) -> Column:
            n, own = self.columns(row), self.column(lon, row)
            return F.transform(F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.pmod(own + i, n))), lambda cx: F.struct(cx.alias("cx"), row.alias("cy")))

        own = self.row(lat)
        return F.flatten(F.transform(F.sequence(own - 1, own + 1), beside))


def _from_grid(points: DataFrame, targets: DataFrame, k: int, other_than_self: bool) -> DataFrame:
    own = 1 if other_than_self else 0  # one of the targets may be the point itself
    at_one_place = Window.partitionBy("lon", "lat").orderBy("ord")
    targets = targets.select("ord", "lon", "lat").withColumn("_n", F.row_number().over(at_one_place)).where(F.col("_n") <= k + own).drop("_n")
    n, south, north, west, east = targets.agg(F.count(F.lit(1)), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    size = max(FINEST, math.sqrt(max(1.0, (north - south) * _METRES) * max(1.0, (east - west) * _METRES) / n))
    while True:  # at most some twenty sizes, each one aggregation
        grid = Grid(size)
        dealt = targets.select("ord", F.col("lon").alias("x"), F.col("lat").alias("y")).withColumn("cy", grid.row("y")).withColumn("cx", grid.column("x", F.col("cy")))
        fullest = dealt.groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        if fullest <= FULL or size <= FINEST:
            break
        size = max(FINEST, size / 3)
    dealt = tables.materialise(dealt, "nearest-targets")
    order = Window.partitionBy("id").orderBy("dist", "ord")

    def closest(met: DataFrame) -> DataFrame:
        if other_than_self:
            met = met.where("id <> ord")
        return met.select("id", "ord", haversine_m("lon", "lat", "x", "y").alias("dist")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = closest(points.select("id", "lon", "lat", F.inline(grid.around("lon", "lat"))).join(dealt, ["cx", "cy"]))
    done = tables.materialise(best.join(best.where((F.col("rank") == k) & (F.col("dist") <= size)).select("id"), "id", "left_semi"), "nearest")
    rest = tables.materialise(points.select("id", "lon", "lat").join(done.select("id").distinct(), "id", "left_anti"), "nearest-rest")
    if rest.isEmpty():
        return done

    # the rest: wider and wider areas, first by the boxes of their cells
    boxes = tables.materialise(dealt.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("t")), "nearest-cells")
    apart = lambda lon: F.least(F.abs(lon - F.col("lon")), 360 - F.abs(lon - F.col("lon")))
    inside = lambda low, high, at: (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    # least: to the nearest corner by latitude alone, or along the parallel farthest from the equator; most: the four corners
    d_lat = F.when(inside("s", "t", "lat"), 0.0).otherwise(F.least(F.abs(F.col("s") - F.col("lat")), F.abs(F.col("t") - F.col("lat"))))
    d_lon = F.when(inside("w", "e", "lon"), 0.0).otherwise(F.least(apart(F.col("w")), apart(F.col("e"))))
    steep = F.greatest(F.abs(F.col("s")), F.abs(F.col("t")), F.abs(F.col("lat")))
    least = F.greatest(haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), d_lat), haversine_m(F.lit(0.0), steep, d_lon, steep)) * 0.999
    most = F.greatest(*[haversine_m("lon", "lat", x, y) for x in ("w", "e") for y in ("s", "t")]) + 2 * haversine_m("w", "s", "e", "t")
    wide = Grid(size)
    while True:
        wide = Grid(wide.size * 3)
        last = wide.size > 20_100_000  # half way around: the areas about a point hold everything
        area = boxes.withColumn("ay", wide.row("s")).withColumn("ax", wide.column("w", F.col("ay")))
        probes = rest.select("id", "lon", "lat", F.inline(wide.around("lon", "lat"))).withColumnsRenamed({"cx": "ax", "cy": "ay"}).join(area, ["ax", "ay"])
        seen = probes.select("id", "lon", "lat", "cx", "cy", "n", least.alias("least"), most.alias("most"))
        running = Window.partitionBy("id").orderBy("most").rowsBetween(Window.unboundedPreceding, 0)
        limit = seen.withColumn("sum", F.sum("n").over(running)).where(F.col("sum") >= k + own).groupBy("id").agg(F.min("most").alias("limit"))
        wanted = seen.join(limit, "id", "left").where(F.col("limit").isNull() | (F.col("least") <= F.col("limit"))).select("id", "lon", "lat", "cx", "cy")
        best = closest(wanted.join(dealt, ["cx", "cy"]))
        found = best if last else best.join(best.where((F.col("rank") == k) & (F.col("dist") <= wide.size - 2 * size)).select("id"), "id", "left_semi")
        found = tables.materialise(found, "nearest")
        done = done.union(found)
        if last:
            return done
        rest = tables.materialise(rest.join(found.select("id").distinct(), "id", "left_anti"), "nearest-rest")
        if rest.isEmpty():
            return done
