"""A deterministic map extract as OpenStreetMap XML over the star-schema tables, and the same in SQL.

Parts are nodes and points of interest, orders are ways through them, and every nation has a place, a hall, a barrier,
an area and a multipolygon about its middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from . import synthetic
from .oracles import D, haversine, importance, salience, tier

#: (number, east, north) of a nation's own nodes, in degrees from its middle; h is the half of its hall.
CORNERS = (
    (0, "-0.003 - h", "-0.003 - h"), (1, "-0.003 + h", "-0.003 - h"), (2, "-0.003 + h", "-0.003 + h"), (3, "-0.003 - h", "-0.003 + h"),
    (10, "-0.004", "-0.004"), (11, "-0.002", "-0.0015"), (12, "0.0", "0.001"), (13, "0.002", "0.0015"), (14, "0.004", "0.002"),
    (20, "0.001", "0.001"), (21, "0.002", "0.001"), (22, "0.002", "0.0025"), (23, "0.001", "0.002"),
    (30, "-0.002", "0.002"), (31, "-0.001", "0.002"), (32, "-0.001", "0.003"), (33, "-0.002", "0.003"),
    (40, "-0.0018", "0.0022"), (41, "-0.0012", "0.0022"), (42, "-0.0012", "0.0028"), (43, "-0.0018", "0.0028"), (50, "-0.0015", "0.0025"),
)
#: Ways by number: their nodes.
LINES = {1: (0, 1, 2, 3, 0), 2: (10, 11, 12, 13, 14), 3: (20, 21, 22, 23), 4: (30, 31, 32), 5: (32, 33, 30), 6: (40, 41, 42, 43, 40), 7: (50,)}


def _tag(key: str, value) -> F.Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.concat(F.lit(f'<tag k="{key}" v="'), value, F.lit('"/>'))).otherwise("")


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, j, lon and lat of the nations' own nodes."""
    rows = synthetic.places(spark, sf_dir).withColumn("h", F.lit(5e-5) + F.lit(3e-5) * (F.col("pos") % 5))
    at = F.array(*[F.struct(F.lit(j).alias("j"), (F.col("lon") + F.expr(f"cast({x.split(' ')[0]} as double)") + _half(x)).alias("lon"), (F.col("lat") + F.expr(f"cast({y.split(' ')[0]} as double)") + _half(y)).alias("lat")) for j, x, y in CORNERS])
    return rows.select("pos", F.inline(at))


def _half(offset: str) -> F.Column:
    return F.col("h") if offset.endswith("+ h") else -F.col("h") if offset.endswith("- h") else F.lit(0.0)


def write(spark: SparkSession, sf_dir: str) -> str:
    """The extract as a folder of XML files of bounded sizes."""
    n = F.col("pos")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda by, *values: F.coalesce(*[F.when(by == i, v) for i, v in enumerate(values) if v])
    tags = F.concat(
        _tag("amenity", pick(key % 6, "cafe", "bench", "school", "bank", "place_of_worship")), _tag("tourism", pick(key % 5, "museum", "hotel")), _tag("shop", F.when(size % 7 == 0, F.lower("p_type"))), _tag("natural", F.when(key % 10 == 3, "tree")),
        _tag("name", F.when(size % 3 != 0, F.concat(F.lit("Site "), (key % 40).cast("string")))), _tag("brand", F.when(size % 5 == 0, F.col("p_brand"))), _tag("addr:street", F.when(key % 8 == 0, F.concat(F.lit("Given "), (key % 9).cast("string")))),
    )
    lon, lat = synthetic.node_lon(key), synthetic.node_lat(key)
    parts = [
        synthetic.table(spark, sf_dir, "part").where(key % 13 != 0).select(text('<node id="', key, '" lat="', lat, '" lon="', lon, '">', tags, "</node>")),
        _corners(spark, sf_dir).select(text('<node id="', n * 100 + F.col("j") + 10_000_000, '" lat="', F.col("lat"), '" lon="', F.col("lon"), '"/>')),
        synthetic.places(spark, sf_dir).select(text('<node id="', n + 20_000_000, '" lat="', F.col("lat"), '" lon="', F.col("lon"), '">', _tag("place", pick(n % 3, "neighbourhood", "quarter", "suburb")), _tag("name", F.col("name")), "</node>")),
        synthetic.places(spark, sf_dir).select(text('<node id="', n + 30_000_000, '" lon="1.5">', _tag("amenity", "cafe"), "</node>")),
    ]
    way = F.col("way")
    refs = synthetic.way_refs(spark, sf_dir).groupBy("way").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda s: F.concat(F.lit('<nd ref="'), s["node"].cast("string"), F.lit('"/>'))), "").alias("nds"))
    parts.append(refs.select(text('<way id="', way, '">', F.col("nds"), F.when(way % 5 == 2, F.concat(_tag("amenity", "school"), _tag("name", F.concat(F.lit("School "), way.cast("string"))), _tag("addr:street", F.concat(F.lit("Yard "), (way % 9).cast("string"))))).otherwise(F.concat(_tag("highway", "residential"), _tag("name", F.concat(F.lit("Way "), (way % 50).cast("string"))))), "</way>")))
    kinds = {
        1: F.concat(_tag("building", "university"), _tag("name", F.concat(F.lit("Hall "), n.cast("string")))),
        2: F.concat(_tag("highway", F.when(n % 3 == 0, "motorway")), _tag("railway", F.when(n % 3 == 1, "rail")), _tag("waterway", F.when(n % 3 == 2, "river")), _tag("name", F.when(n % 3 == 1, "  ").otherwise(F.concat(F.lit("Route "), (n % 7).cast("string")))), _tag("ref", F.concat(F.lit("R "), n.cast("string")))),
        3: F.concat(_tag("natural", F.when(n % 2 == 0, "water")), _tag("leisure", F.when(n % 2 == 1, "park")), _tag("name", F.concat(F.lit("Area "), n.cast("string")))),
    }
    for number, nodes in LINES.items():
        nds = F.concat(*[F.concat(F.lit('<nd ref="'), (n * 100 + j + 10_000_000).cast("string"), F.lit('"/>')) for j in nodes])
        parts.append(synthetic.places(spark, sf_dir).select(text('<way id="', n * 10 + number + 40_000_000, '">', nds, kinds.get(number, F.lit("")), "</way>")))
    parts.append(synthetic.places(spark, sf_dir).select(text('<way id="', n + 50_000_000, '">', _tag("highway", "service"), "</way>")))  # no nodes
    member = lambda number, role: F.concat(F.lit('<member type="way" ref="'), (n * 10 + number + 40_000_000).cast("string"), F.lit(f'" role="{role}"/>'))
    ring = F.concat(member(4, "outer"), member(5, "outer"), member(6, "inner"), member(9, "outer"))
    members = F.when(n % 3 == 0, ring).when(n % 3 == 1, member(4, "")).otherwise(F.concat(member(7, "outer"), member(6, "inner")))
    area = F.concat(_tag("natural", F.when(n % 3 < 2, "water")), _tag("landuse", F.when(n % 3 == 2, "cemetery")), _tag("name", F.concat(F.lit("Bay "), n.cast("string"))))
    parts.append(synthetic.places(spark, sf_dir).select(text('<relation id="', n + 60_000_000, '">', members, _tag("type", "multipolygon"), area, "</relation>")))
    parts.append(synthetic.places(spark, sf_dir).select(text('<relation id="', n + 70_000_000, '">', members, _tag("type", "boundary"), area, "</relation>")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    path = tables.folder(spark, "extract.osm")
    blocks = 3 + spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 50_000  # several documents at every size
    dealt = out.groupBy(F.pmod(F.xxhash64("value"), F.lit(blocks)).alias("block")).agg(F.concat(F.lit("<osm>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit("\n</osm>")).alias("value"))
    dealt.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    return path


def _coordinate(axis: str, offset: str) -> str:
    number, *half = offset.split(" ", 1)
    return f"{axis} + {D(repr(number))}" + (f" {half[0]}" if half else " + 0e0")


_summed = "list_reduce(list({} order by i), lambda a, b: a + b)".format

#: CTEs, each with those it needs; see oracles.needs.
CTES = {
    "x_corner": " union all ".join(f"select pos, {j} as j, {_coordinate('lon', x)} as lon, {_coordinate('lat', y)} as lat from (select *, 5e-5 + 3e-5 * (pos % 5) as h from place)" for j, x, y in CORNERS),
    "x_line": "select pos, w, node, row_number() over (partition by pos, w order by i) as i, lon, lat from (select pos, w, unnest(nodes) as node, generate_subscripts(nodes, 1) as i from place, (values "
    + ", ".join(f"({w}, {list(nodes)})" for w, nodes in LINES.items())
    + ") v(w, nodes)) l join (select pos as p, j, lon, lat from x_corner) c on c.p = l.pos and c.j = l.node",
    "x_part": """select p_partkey as id, case p_partkey % 6 when 0 then 'cafe' when 1 then 'bench' when 2 then 'school' when 3 then 'bank' when 4 then 'place_of_worship' end as amenity, case when p_partkey % 5 = 0 then 'museum' when p_partkey % 5 = 1 then 'hotel' end as tourism,
        case when p_size % 7 = 0 then lower(p_type) end as shop, case when p_partkey % 10 = 3 then 'tree' end as nat, case when p_size % 3 <> 0 then 'Site ' || (p_partkey % 40) end as name, case when p_size % 5 = 0 then p_brand end as brand, case when p_partkey % 8 = 0 then 'Given ' || (p_partkey % 9) end as given, lon, lat
      from part join node on node = p_partkey""",
    "x_node_poi": """select 'n' || id as osm_id, coalesce(name, brand) as name, brand is not null as chain, given, lon, lat, case when amenity = 'bench' or nat = 'tree' then null when tourism = 'museum' then 'landmark.museum' when amenity = 'place_of_worship' then 'landmark.place_of_worship' when amenity = 'school' then 'civic.school'
        when amenity = 'cafe' then 'food.cafe' when amenity = 'bank' then 'shop.bank' when shop = 'deli' then 'food.deli' when shop is not null then 'shop.' || shop when tourism = 'hotel' then 'lodging.hotel' end as category from x_part""",
    # sums in the order of the vertices, as the engine adds them up: means of lattice points are often ties at seven places
    "x_ring": f"select way, any_value(n) as n, {_summed('w')} as a2, {_summed('(px + qx) * w')} as mx, {_summed('(py + qy) * w')} as my, any_value(fx) as fx, any_value(fy) as fy, {_summed('lon')} / any_value(n) as ax, {_summed('lat')} / any_value(n) as ay, bool_or(i = n and px = 0 and py = 0) as closed from (select *, px * qy - qx * py as w from (select way, i, n, px as lon, py as lat, px - fx as px, py - fy as py, qx - fx as qx, qy - fy as qy, fx, fy from (select *, first_value(px) over w as fx, first_value(py) over w as fy from hop window w as (partition by way order by i)))) group by way",
    "x_way_poi": "select 'w' || way as osm_id, 'School ' || way as name, false as chain, 'Yard ' || (way % 9) as given, case when closed and n >= 4 and a2 <> 0 then fx + mx / (3 * a2) else ax end as lon, case when closed and n >= 4 and a2 <> 0 then fy + my / (3 * a2) else ay end as lat, 'civic.school' as category, 0 as bonus from x_ring where way % 5 = 2",
    "x_hall": "select 'w' || (pos * 10 + 40000001) as osm_id, 'Hall ' || pos as name, false as chain, null as given, lon - 3e-3 as lon, lat - 3e-3 as lat, 'civic.university_building' as category, case when a <= 200 then 0 else least(9, cast(round_even(5 * log10(a / 200), 0) as int)) end as bonus from (select *, power(2 * (5e-5 + 3e-5 * (pos % 5)) * 111320e0, 2) * cos(radians(lat - 3e-3)) as a from place)",
}
NEEDS = {"x_corner": ("place",), "x_line": ("x_corner",), "x_part": ("node",), "x_node_poi": ("x_part",), "x_ring": ("hop",), "x_way_poi": ("x_ring",), "x_hall": ("place",)}


def merge_ctes(prefix: str, source: str) -> dict[str, str]:
    """Co-location merging of source(rid, osm_id, name, importance, category, lon, lat, ...): named rows in turn, each
    against those kept before it, then unnamed rows against the kept named ones of their class."""
    k = "substr(category, 1, instr(category, '.') - 1)"
    near = haversine("p.lon", "p.lat", "g.lon", "g.lat")
    return {
        f"{prefix}_named": f"select *, {k} as k, row_number() over (partition by {k}, name order by importance desc, osm_id, rid) as rn from {source} where name is not null",
        f"{prefix}_greedy": f"""select rid, k, name, rn, lon, lat, [{{'lon': lon, 'lat': lat}}] as kept, true as ok from {prefix}_named where rn = 1
          union all select rid, k, name, rn, lon, lat, case when met then kept else list_append(kept, {{'lon': lon, 'lat': lat}}) end, not met
          from (select g.*, q.kept, len(list_filter(q.kept, lambda p: {near} <= 40)) > 0 as met from {prefix}_greedy q join {prefix}_named g on g.k = q.k and g.name = q.name and g.rn = q.rn + 1)""",
        f"{prefix}_kept": f"select s.* from {source} s where rid in (select rid from {prefix}_greedy where ok) or (name is null and not exists (select 1 from {prefix}_greedy g where g.ok and g.k = {k.replace('category', 's.category')} and {haversine('g.lon', 'g.lat', 's.lon', 's.lat')} <= 40))",
    }


_ROUND7 = "round_even({} * 1e7, 0) / 1e7".format
CTES |= {
    "x_poi0": "select osm_id, name, chain, given, lon, lat, category, 0 as bonus from x_node_poi where category is not null union all select osm_id, name, chain, given, lon, lat, category, bonus from x_way_poi union all select osm_id, name, chain, given, lon, lat, category, bonus from x_hall",
    "x_poi1": f"select *, cast({importance('category', 'name is not null', 'chain')} as int) as base, {salience('category')} as salience from x_poi0",
    "x_poi": f"select osm_id as rid, osm_id, name, given, lon, lat, category, cast(least(100, base + bonus) as int) as importance, {tier('base')} as tier, salience from x_poi1",
    "x_road": "select way as road, seq, street, x1, y1, x2, y2 from road where way % 5 <> 2 union all select 1000000000 + a.pos, a.i, 'Route ' || (a.pos % 7), a.lon, a.lat, b.lon, b.lat from x_line a join x_line b on a.w = 2 and b.w = 2 and a.pos = b.pos and b.i = a.i + 1 and a.pos % 3 = 0",
    "x_snap": """select rid, street from (select rid, street, d, row_number() over (partition by rid order by d, road, seq) as rn from (
        select rid, road, seq, street, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) as d from (select *, case when dx * dx + dy * dy > 0 then greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) else 0e0 end as t from (
          select p.rid, road, seq, r.street, (x1 - lon) * k as ax, (y1 - lat) * 110540e0 as ay, (x2 - x1) * k as dx, (y2 - y1) * 110540e0 as dy from (select *, 111320e0 * cos(radians(lat)) as k from x_poi where given is null) p
          join x_road r on least(x1, x2) - 1e-3 <= lon and greatest(x1, x2) + 1e-3 >= lon and least(y1, y2) - 1e-3 <= lat and greatest(y1, y2) + 1e-3 >= lat)))) where rn = 1 and d <= 30""",
    "x_placed": f"select rid, osm_id, name, category, importance, tier, salience, coalesce(given, s.street) as street, case when given is null and s.street is not null then true end as street_approx, {_ROUND7('lon')} as lon, {_ROUND7('lat')} as lat from x_poi left join x_snap s using (rid)",
    **merge_ctes("x", "x_placed"),
    "x_shape": """select 'place' as kind, 'n' || (pos + 20000000) as osm_id, name, null::varchar as cls, 'Point' as geom_type, 1 as n, lon as west, lat as south from place where pos % 3 < 2
      union all select 'barrier', 'w' || (pos * 10 + 40000002), case when pos % 3 = 1 then 'R ' || pos else 'Route ' || (pos % 7) end, case pos % 3 when 0 then 'motorway' when 1 then 'rail' else 'water' end, 'LineString', 3, lon - 4e-3, lat - 4e-3 from place
      union all select case when pos % 2 = 0 then 'water' else 'park' end, 'w' || (pos * 10 + 40000003), 'Area ' || pos, null, 'Polygon', 5, lon + 1e-3, lat + 1e-3 from place
      union all select case when pos % 3 < 2 then 'water' else 'park' end, 'r' || (pos + 60000000) || case pos % 3 when 0 then '-0' when 1 then '-L0' else '' end, 'Bay ' || pos, null, case when pos % 3 = 1 then 'LineString' else 'Polygon' end, case when pos % 3 = 1 then 3 else 5 end,
        case when pos % 3 < 2 then lon - 2e-3 else lon - 18e-4 end, case when pos % 3 < 2 then lat + 2e-3 else lat + 22e-4 end from place""",
    "x_all": "select 'poi' as kind, osm_id, name, category, importance, tier, salience, street, street_approx, null::varchar as barrier_class, 'Point' as geom_type, 1 as n, lon as west, lat as south from x_kept union all select kind, osm_id, name, null, null, null, null, null, null, cls::varchar, geom_type, n, west, south from x_shape",
}
NEEDS |= {
    "x_poi0": ("x_node_poi", "x_way_poi", "x_hall"), "x_poi1": ("x_poi0",), "x_poi": ("x_poi1",), "x_road": ("road", "x_line"), "x_snap": ("x_poi", "x_road"), "x_placed": ("x_poi", "x_snap"), "x_named": ("x_placed",), "x_greedy": ("x_named",), "x_kept": ("x_placed", "x_greedy"), "x_shape": ("place",), "x_all": ("x_kept", "x_shape"),
}
