"""Geometry of points, segments and rings as column expressions.

A point is a struct<lon, lat>; lines and rings are arrays of points. Everything stays inside Spark SQL: built-in
arithmetic and higher-order functions. Three metric conventions are kept apart on purpose: great circles of a
sphere, metres per degree that differ between the axes, and one figure for both axes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map conventions.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_LON, METRES_PER_LAT = 111_320.0, 110_540.0
WINDS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
ADJACENT_M, NEAR_M, SHORT_WALK_M = 25.0, 150.0, 500.0


def c(x) -> Column:
    """A column by name, or the column itself."""
    return F.col(x) if isinstance(x, str) else x


def point(lon, lat) -> Column:
    return F.struct(c(lon).alias("lon"), c(lat).alias("lat"))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres."""
    lon1, lat1, lon2, lat2 = c(lon1), c(lat1), c(lon2), c(lat2)
    d_lat, d_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(d_lat) * F.sin(d_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(d_lon) * F.sin(d_lon)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def eight_wind(lon1, lat1, lon2, lat2) -> Column:
    """The initial bearing's nearest of eight winds; ties go to the even one."""
    lon1, lat1, lon2, lat2 = c(lon1), c(lat1), c(lon2), c(lat2)
    d_lon, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    y = F.sin(d_lon) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d_lon)
    eighth = F.rint(((F.degrees(F.atan2(y, x)) + 360.0) % 360.0) / 45.0).cast("int") % 8
    return F.element_at(F.array(*[F.lit(w) for w in WINDS]), eighth + 1)


def bucket(metres, adjacent: float = ADJACENT_M, near: float = NEAR_M, short_walk: float = SHORT_WALK_M) -> Column:
    m = c(metres)
    return F.when(m < adjacent, "adjacent").when(m < near, "near").when(m < short_walk, "short walk").otherwise("far")


def round_m(metres, step: int = 5) -> Column:
    """Half-even to the step, as an integer."""
    return (F.rint(c(metres) / step) * step).cast("int")


def round7(x) -> Column:
    return F.rint(c(x) * 1e7) / 1e7


def point_segment_m(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """Metres from a point to a segment, in the plane about the point."""
    lon, lat, lon1, lat1, lon2, lat2 = (c(x) for x in (lon, lat, lon1, lat1, lon2, lat2))
    per_lon = METRES_PER_LON * F.cos(F.radians(lat))
    ax, ay = (lon1 - lon) * per_lon, (lat1 - lat) * METRES_PER_LAT
    dx, dy = (lon2 - lon1) * per_lon, (lat2 - lat1) * METRES_PER_LAT
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length2))).otherwise(F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def _turn(ox, oy, px, py, qx, qy) -> Column:
    return (px - ox) * (qy - oy) - (py - oy) * (qx - ox)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments a-b and c-d cross properly; each of the four tests is strict on one side only."""
    ax, ay, bx, by, cx, cy, dx, dy = (c(x) for x in (ax, ay, bx, by, cx, cy, dx, dy))
    side = lambda *p: _turn(*p) > 0
    return (side(cx, cy, dx, dy, ax, ay) != side(cx, cy, dx, dy, bx, by)) & (side(ax, ay, bx, by, cx, cy) != side(ax, ay, bx, by, dx, dy))


def edges_of(ring: Column, closed: bool = True) -> Column:
    """The ring's or line's segments as struct<p, q>; a ring's last vertex is followed by its first."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)) if closed else F.slice(ring, 2, n)
    pairs = F.arrays_zip(ring.alias("p"), following.alias("q")) if closed else F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("p"), following.alias("q"))
    return F.when(n >= 2, F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q")))).otherwise(F.array().cast("array<struct<p:struct<lon:double,lat:double>,q:struct<lon:double,lat:double>>>"))


def point_in_ring(lon, lat, ring: Column) -> Column:
    """Even-odd rule; the ring may be open or closed."""
    lon, lat = c(lon), c(lat)

    def hit(e):
        # the edge as the ray test sees it: from a vertex back to the one before
        i, j = e["q"], e["p"]
        return ((i["lat"] > lat) != (j["lat"] > lat)) & (lon < (j["lon"] - i["lon"]) * (lat - i["lat"]) / F.nullif(j["lat"] - i["lat"], F.lit(0.0)) + i["lon"])

    return F.size(F.filter(edges_of(ring), hit)) % 2 == 1


def mean_of(points: Column, axis: str) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)


def _shoelace(ring: Column, per_lon: Column, per_lat: float) -> Column:
    return F.abs(F.aggregate(edges_of(ring), F.lit(0.0), lambda s, e: s + (e["p"]["lon"] * per_lon * e["q"]["lat"] * per_lat - e["q"]["lon"] * per_lon * e["p"]["lat"] * per_lat))) / 2


def footprint_m2(ring: Column) -> Column:
    """Area with one figure for both axes and the mean latitude; 0 for fewer than three vertices."""
    per_lon = METRES_PER_LON * F.cos(F.radians(mean_of(ring, "lat")))
    return F.when(F.size(ring) >= 3, _shoelace(ring, per_lon, METRES_PER_LON)).otherwise(F.lit(0.0))


def ring_area_m2(ring: Column) -> Column:
    """Area with the latitude of the first vertex; 0 for fewer than three vertices."""
    per_lon = METRES_PER_LON * F.cos(F.radians(F.get(ring, F.lit(0))["lat"]))
    return F.when(F.size(ring) >= 3, _shoelace(ring, per_lon, METRES_PER_LAT)).otherwise(F.lit(0.0))


def closed_ring(points: Column) -> Column:
    """The points with the first one appended, unless it is already last."""
    return F.when((F.size(points) >= 1) & (F.get(points, F.lit(0)) != F.element_at(points, -1)), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def representative_point(points: Column) -> Column:
    """The area centroid of a closed ring with an area, else the mean of the vertices; null for no vertex."""
    first = F.get(points, F.lit(0))
    closed = (F.size(points) >= 4) & (first == F.element_at(points, -1))
    mean = point(mean_of(points, "lon"), mean_of(points, "lat"))
    moved = F.transform(points, lambda p: point(p["lon"] - first["lon"], p["lat"] - first["lat"]))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s, e):
        w = e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"]
        return F.struct((s["a"] + w).alias("a"), (s["x"] + (e["p"]["lon"] + e["q"]["lon"]) * w).alias("x"), (s["y"] + (e["p"]["lat"] + e["q"]["lat"]) * w).alias("y"))

    s = F.aggregate(edges_of(moved, closed=False), zero, add)
    centre = point(first["lon"] + s["x"] / (3 * F.nullif(s["a"], F.lit(0.0))), first["lat"] + s["y"] / (3 * F.nullif(s["a"], F.lit(0.0))))
    return F.when(F.size(points) == 0, F.lit(None)).when(closed & (s["a"] != 0), centre).otherwise(mean)


def axis_angle(sxx, syy, sxy) -> Column:
    """The main axis of a cloud from its moments, as struct<ux, uy> that points north, or east if level."""
    theta = 0.5 * F.atan2(2 * c(sxy), c(sxx) - c(syy))
    ux, uy = F.cos(theta), F.sin(theta)
    flip = (uy < -1e-9) | ((F.abs(uy) <= 1e-9) & (ux < 0))
    return F.struct(F.when(flip, -ux).otherwise(ux).alias("ux"), F.when(flip, -uy).otherwise(uy).alias("uy"))


def axis_label(ux, uy) -> Column:
    a = F.degrees(F.atan2(c(ux), c(uy)))
    return F.when(F.abs(a) < 22.5, "N–S").when(F.abs(a) >= 67.5, "E–W").when(a > 0, "NE–SW").otherwise("NW–SE")


def moments(points: Column) -> Column:
    """struct<sxx, syy, sxy> of the points about their mean, in local metres."""
    lon, lat = mean_of(points, "lon"), mean_of(points, "lat")
    per_lon = METRES_PER_LON * F.cos(F.radians(lat))
    local = F.transform(points, lambda p: F.struct(((p["lon"] - lon) * per_lon).alias("x"), ((p["lat"] - lat) * METRES_PER_LAT).alias("y")))
    total = lambda f: F.aggregate(local, F.lit(0.0), lambda s, p: s + f(p))
    return F.struct(total(lambda p: p["x"] * p["x"]).alias("sxx"), total(lambda p: p["y"] * p["y"]).alias("syy"), total(lambda p: p["x"] * p["y"]).alias("sxy"))


def position_in(points: Column, bounds: Column, linear) -> Column:
    """Where a shape lies in bounds [min lon, min lat, max lon, max lat]."""
    at = lambda i: F.get(bounds, F.lit(i))
    width, height = at(2) - at(0), at(3) - at(1)
    mid_lon, mid_lat = (at(0) + at(2)) / 2, (at(1) + at(3)) / 2
    lon, lat = mean_of(points, "lon"), mean_of(points, "lat")
    central = (width > 0) & (F.abs(lon - mid_lon) < width * 0.12) & (height > 0) & (F.abs(lat - mid_lat) < height * 0.12)
    octant = F.when(central, "central").otherwise(eight_wind(mid_lon, mid_lat, lon, lat))
    m = moments(points)
    axis = axis_angle(m["sxx"], m["syy"], m["sxy"])
    runs = F.when(F.size(points) <= 1, F.lit("N–S")).otherwise(axis_label(axis["ux"], axis["uy"]))
    span = lambda axis, full: F.when(full > 0, (F.array_max(F.transform(points, lambda p: p[axis])) - F.array_min(F.transform(points, lambda p: p[axis]))) / full).otherwise(F.lit(0.0))
    wide = (span("lon", width) > 0.4) | (span("lat", height) > 0.4)
    along = F.when(central, F.concat(F.lit("runs "), runs)).otherwise(F.concat(F.lit("runs "), runs, F.lit(", "), octant))
    return F.when((F.size(points) == 0) | (F.size(bounds) != 4), "central").when(c(linear), along).when(wide & ~central, F.concat(octant, F.lit(" edge"))).otherwise(octant)


def boxes_overlap(a_min_lon, a_min_lat, a_max_lon, a_max_lat, b_min_lon, b_min_lat, b_max_lon, b_max_lat) -> Column:
    return (c(a_min_lon) <= c(b_max_lon)) & (c(a_max_lon) >= c(b_min_lon)) & (c(a_min_lat) <= c(b_max_lat)) & (c(a_max_lat) >= c(b_min_lat))


def equirectangular_fit(lon, lat, bounds: Column, width: float, height: float, pad: float = 24.0) -> Column:
    """struct<x, y> of a point in a view: cosine-compressed, one scale, centred, north up."""
    at = lambda i: F.get(bounds, F.lit(i))
    squeeze = F.cos(F.radians((at(1) + at(3)) / 2))
    span_x, span_y = F.greatest((at(2) - at(0)) * squeeze, F.lit(1e-9)), F.greatest(at(3) - at(1), F.lit(1e-9))
    scale = F.least((width - 2 * pad) / span_x, (height - 2 * pad) / span_y)
    x = (width - span_x * scale) / 2 + (c(lon) - at(0)) * squeeze * scale
    y = (height - span_y * scale) / 2 + (at(3) - c(lat)) * scale
    return F.struct(x.alias("x"), y.alias("y"))
