"""The engine's queries over the synthetic geography, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import geo, text
from ..operators import chunks as chunking
from ..operators import classify, graph, partition, promote, render, stage1, summary
from ..operators.nearest import nearest_k
from ..options import Options
from . import document_oracles, extract, model, oracles, synthetic
from .oracles import haversine, needs, wind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- the chain that most queries share -------------------------------------------------------------------------


def _placed(spark, d) -> DataFrame:
    pois = synthetic.pois(spark, d)
    return promote.promoted_flag(promote.with_district(pois, synthetic.places(spark, d)), 20)


def _promoted(spark, d) -> DataFrame:
    return tables.materialise(promote.promoted_table(tables.materialise(_placed(spark, d), "placed")), "promoted")


def _minors(spark, d) -> DataFrame:
    return promote.minor_table(_placed(spark, d))


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    """Promoted features and minors, with promotion decided once."""
    placed = tables.materialise(_placed(spark, d), "placed")
    return tables.materialise(promote.promoted_table(placed), "promoted"), promote.minor_table(placed)


def _edges(spark, d, points: DataFrame | None = None) -> DataFrame:
    """points: the promoted features, if they are there."""
    return graph.edges(_promoted(spark, d) if points is None else points, synthetic.features(spark, d), Options())


def _pairs(spark, d) -> DataFrame:
    """Every point and the next one of its table, by key."""
    one = synthetic.pois(spark, d).select("key", (F.col("segment") == "CIVIC").alias("civic"), "lon", "lat")
    two = one.select((F.col("key") - 1).alias("key"), "civic", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return one.join(two, ["key", "civic"]).drop("civic")


_PAIRS = "(select a.key, a.lon, a.lat, b.lon as lon2, b.lat as lat2 from poi a join poi b on (a.segment = 'CIVIC') = (b.segment = 'CIVIC') and b.key = a.key + 1)"

# --- scalars ---------------------------------------------------------------------------------------------------


@query(needs(f"select key, cast(round_even({haversine('lon', 'lat', 'lon2', 'lat2')}, 0) as bigint) as metres from {_PAIRS}", "poi"))
def haversine_m(spark, d):
    return _pairs(spark, d).select("key", F.rint(geo.haversine_m("lon", "lat", "lon2", "lat2")).cast("long").alias("metres"))


@query(needs(f"select key, {wind('lon', 'lat', 'lon2', 'lat2')} as wind from {_PAIRS}", "poi"))
def eight_wind(spark, d):
    return _pairs(spark, d).select("key", geo.eight_wind("lon", "lat", "lon2", "lat2").alias("wind"))


@query(needs(f"select key, {oracles.bucket(haversine('lon', 'lat', 'lon2', 'lat2'))} as bucket, {oracles.round_m(haversine('lon', 'lat', 'lon2', 'lat2'))} as meters from {_PAIRS}", "poi"))
def bucket_round(spark, d):
    m = geo.haversine_m("lon", "lat", "lon2", "lat2")
    return _pairs(spark, d).select("key", geo.bucket(m).alias("bucket"), geo.round_m(m).alias("meters"))


_PS = "select key, x1 - lon as ax, y1 - lat as ay, x2 - x1 as dx, y2 - y1 as dy, 111320e0 * cos(radians(lat)) as k from (select key, lon, lat, lon2 as x1, lat2 as y1, lon2 + 1e-3 as x2, lat2 - 5e-4 as y2 from {}) q"


@query(needs(f"select key, cast(round_even(sqrt(power(ax * k + t * dx * k, 2) + power(ay * 110540e0 + t * dy * 110540e0, 2)), 0) as bigint) as metres from (select *, greatest(0e0, least(1e0, -(ax * k * dx * k + ay * 110540e0 * dy * 110540e0) / (power(dx * k, 2) + power(dy * 110540e0, 2)))) as t from ({_PS.format(_PAIRS)}))", "poi"))
def point_segment_m(spark, d):
    rows = _pairs(spark, d).withColumn("x2", F.col("lon2") + F.lit(0.001)).withColumn("y2", F.col("lat2") - F.lit(0.0005))
    return rows.select("key", F.rint(geo.point_segment_m("lon", "lat", "lon2", "lat2", "x2", "y2")).cast("long").alias("metres"))


@query(needs(f"select p.key, s.pos, s.cx < s.dx as east, {oracles.cross('lon', 'lat', 'lon2', 'lat2', 'cx', 'cy', 'dx', 'dy')} as crosses from {_PAIRS} p join seg s on s.kind = 'barrier' and s.pos = 100 + p.key % 25", "poi", "seg"))
def segments_cross(spark, d):
    barriers = synthetic.shapes(spark, d).where("kind = 'barrier'").select("pos", F.explode(geo.edges_of(F.col("pts"), closed=False)).alias("e"))
    rows = _pairs(spark, d).withColumn("pos", 100 + F.col("key") % 25).join(barriers, "pos")
    e = F.col("e")
    return rows.select("key", "pos", (e.p.lon < e.q.lon).alias("east"), geo.segments_cross("lon", "lat", "lon2", "lat2", e.p.lon, e.p.lat, e.q.lon, e.q.lat).alias("crosses"))


@query(needs("select poi.id, s.pos, count(*) filter (where (s.dy > poi.lat) <> (s.cy > poi.lat) and poi.lon < (s.cx - s.dx) * (poi.lat - s.dy) / (s.cy - s.dy) + s.dx) % 2 = 1 as inside from poi join seg s on s.kind <> 'barrier' and s.pos % 100 = poi.nation group by poi.id, s.pos", "poi", "seg"))
def point_in_ring(spark, d):
    rings = synthetic.shapes(spark, d).where("kind <> 'barrier'").withColumn("nation", F.col("pos") % 100)
    return synthetic.pois(spark, d).join(rings.select("pos", "pts", "nation"), "nation").select("id", "pos", geo.point_in_ring("lon", "lat", F.col("pts")).alias("inside"))


@query(needs("select n_nationkey as pos, 'Cell ' || n_name || ' — №' || n_nationkey as name, trim(regexp_replace(lower('Cell ' || n_name || ' — №' || n_nationkey), '[^a-z0-9]+', '-', 'g'), '-') as slug, '[' || lpad(cast(n_nationkey as varchar), 3, '0') || ']' as token from nation"))
def labels(spark, d):
    name = F.concat(F.lit("Cell "), "n_name", F.lit(" — №"), F.col("n_nationkey").cast("string"))
    return synthetic.table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), name.alias("name"), text.slug(name).alias("slug"), text.token("n_nationkey", F.lit(999)).alias("token"))


# --- scans, classes and names -----------------------------------------------------------------------------------


@query(needs("select id, coalesce(name, translate(substr(category, instr(category, '.') + 1), '_', ' ')) as name, category, importance, coalesce(street_approx, false) as street_approx from poi where category is not null and importance >= 50", "poi"))
def scan_filter_project(spark, d):
    rows = synthetic.pois(spark, d).where("category is not null and importance >= 50")
    return rows.select("id", text.name_of("name", "category").alias("name"), "category", "importance", F.coalesce("street_approx", F.lit(False)).alias("street_approx"))


_TAGS = "select p_partkey as id, case p_partkey % 6 when 0 then 'cafe' when 1 then 'bench' when 2 then 'school' when 3 then 'bank' when 4 then 'place_of_worship' end as amenity, case when p_partkey % 5 = 0 then 'museum' when p_partkey % 5 = 1 then 'hotel' end as tourism, case when p_size % 4 = 0 then 'church' when p_size % 4 = 1 then 'house' when p_size % 4 = 2 then 'university' end as building, case when p_size % 7 = 0 then p_type end as shop, case when p_partkey % 10 = 3 then 'tree' end as nat, case when p_size % 3 <> 0 then p_name end as name, case when p_size % 5 = 0 then p_brand end as brand from part"


def _tagged(spark, d) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda by, *values: F.coalesce(*[F.when(by == i, v) for i, v in enumerate(values) if v])
    entries = {
        "amenity": pick(key % 6, "cafe", "bench", "school", "bank", "place_of_worship"), "tourism": pick(key % 5, "museum", "hotel"), "building": pick(size % 4, "church", "house", "university"), "shop": F.when(size % 7 == 0, F.lower("p_type")),
        "natural": F.when(key % 10 == 3, "tree"), "name": F.when(size % 3 != 0, F.col("p_name")), "brand": F.when(size % 5 == 0, F.col("p_brand")),
    }
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values())), lambda k, v: v.isNotNull())
    return synthetic.table(spark, d, "part").select(key.alias("id"), tags.alias("tags"))


_CATEGORY = """case when amenity = 'bench' or nat = 'tree' then null when tourism = 'museum' then 'landmark.museum' when amenity = 'place_of_worship' then 'landmark.place_of_worship' when building = 'church' then 'landmark.church' when amenity = 'school' then 'civic.school'
  when amenity = 'cafe' then 'food.cafe' when amenity = 'bank' then 'shop.bank' when lower(shop) = 'deli' then 'food.deli' when shop is not null then 'shop.' || lower(shop) when tourism = 'hotel' then 'lodging.hotel'
  when building = 'university' and coalesce(name, brand) is not null then 'civic.university_building' when building = 'house' and coalesce(name, brand) is not null then 'residential.house' end"""


@query(f"with t as ({_TAGS}), c as (select id, {_CATEGORY} as category from t) select * from c where category is not null")
def classify_category(spark, d):
    return classify.classified(_tagged(spark, d), classify.tags_of()).select("id", "category")


@query(f"with t as ({_TAGS}), c as (select *, {_CATEGORY} as category from t), s as (select id, category, cast({oracles.importance('category', 'coalesce(name, brand) is not null', 'brand is not null')} as int) as importance from c where category is not null) select *, {oracles.tier('importance')} as tier from s")
def importance_tier(spark, d):
    return classify.classified(_tagged(spark, d), classify.tags_of()).select("id", "category", "importance", "tier")


@query(needs(f"select distinct category, {oracles.salience('category')} as salience, category = 'landmark.church' as worship from poi", "poi"))
def salience(spark, d):
    return synthetic.pois(spark, d).select("category", classify.salience_of("category").alias("salience"), classify.is_worship("category").alias("worship")).distinct()


_NAMES = "select c_custkey as id, case c_custkey % 6 when 0 then '  ' when 1 then 'A' when 2 then '12345' when 3 then c_name || ' of the very long lane' else c_name end as name, case when c_custkey % 4 = 3 then 'Short ' || c_custkey end as short, case when c_custkey % 5 = 0 then c_mktsegment end as brand, case when c_custkey % 3 = 0 then c_name end as op from customer"


@query(f"with t as ({_NAMES}), r as (select id, case when trim(name) <> '' then case when short is not null and length(name) > 30 then short else name end else coalesce(brand, op) end as n from t) select id, case when length(trim(n)) = 1 or regexp_full_match(trim(n), '[0-9]+') then null else n end as name from r")
def name_resolution(spark, d):
    key = F.col("c_custkey")
    name = F.when(key % 6 == 0, "  ").when(key % 6 == 1, "A").when(key % 6 == 2, "12345").when(key % 6 == 3, F.concat("c_name", F.lit(" of the very long lane"))).otherwise(F.col("c_name"))
    found = text.resolve_name(name, F.when(key % 4 == 3, F.concat(F.lit("Short "), key.cast("string"))), F.when(key % 5 == 0, F.col("c_mktsegment")), F.when(key % 3 == 0, F.col("c_name")))
    return synthetic.table(spark, d, "customer").select(key.alias("id"), found.alias("name"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return synthetic.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- ways -------------------------------------------------------------------------------------------------------


def _ways(spark, d) -> DataFrame:
    """way and pts of the ways that have a node."""
    refs = synthetic.way_refs(spark, d).groupBy(F.col("way").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda s: s["node"]).alias("nds"))
    points = synthetic.way_nodes(spark, d).select(F.col("node").alias("id"), geo.point("lon", "lat").alias("pt"))
    return stage1.way_points(refs, points).where("size(pts) > 0").withColumnRenamed("key", "way")


@query(needs("select way, count(*) as n, arg_min(lon, i) as first_lon, arg_max(lat, i) as last_lat from vertex group by way", "vertex"))
def way_nodes_join(spark, d):
    pts = F.col("pts")
    return _ways(spark, d).select("way", F.size(pts).cast("long").alias("n"), F.get(pts, F.lit(0))["lon"].alias("first_lon"), F.element_at(pts, -1)["lat"].alias("last_lat"))


@query(needs("select way, cast(round_even(case when any_value(n) >= 3 then abs(sum(px * k * qy * 111320e0 - qx * k * py * 111320e0)) / 2 else 0 end / 1000, 0) as bigint) as area_1000m2, cast(round_even(avg(px) * 100000 + 137e-3, 0) as bigint) as lon5, cast(round_even(avg(py) * 100000 + 137e-3, 0) as bigint) as lat5 from (select *, 111320e0 * cos(radians(avg(py) over (partition by way))) as k from hop) group by way", "hop"))
def way_area_centroid(spark, d):
    pts = F.col("pts")
    return _ways(spark, d).select("way", F.rint(geo.footprint_m2(pts) / 1000).cast("long").alias("area_1000m2"), F.rint(geo.mean_of(pts, "lon") * 100000 + 0.137).cast("long").alias("lon5"), F.rint(geo.mean_of(pts, "lat") * 100000 + 0.137).cast("long").alias("lat5"))


@query(needs("""select id, street from (select id, street, d, row_number() over (partition by id order by d, way, seq) as rn from (
   select id, way, seq, street, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) as d from (select *, case when dx * dx + dy * dy > 0 then greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) else 0e0 end as t from (
     select poi.id, way, seq, r.street, (x1 - lon) * k as ax, (y1 - lat) * 110540e0 as ay, (x2 - x1) * k as dx, (y2 - y1) * 110540e0 as dy from (select *, 111320e0 * cos(radians(lat)) as k from poi) poi cross join road r)))) where rn = 1 and d <= 30""", "poi", "road"))
def street_snap(spark, d):
    lines = _ways(spark, d).select(F.col("way").alias("road"), F.concat(F.lit("Way "), (F.col("way") % 50).cast("string")).alias("street"), F.posexplode(geo.edges_of(F.col("pts"), closed=False)).alias("at", "e"))
    segments = lines.select("road", "at", "street", F.col("e.p.lon").alias("x1"), F.col("e.p.lat").alias("y1"), F.col("e.q.lon").alias("x2"), F.col("e.q.lat").alias("y2"))
    return stage1.nearest_street(synthetic.pois(spark, d), segments)


_CLASS = "substr(category, 1, instr(category, '.') - 1)"


@query(needs(f"select a.id from poi a where a.name is null and not exists (select 1 from poi b where b.name is not null and {_CLASS.replace('category', 'a.category')} = {_CLASS.replace('category', 'b.category')} and {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 40)", "poi"))
def colocation_unnamed_anti(spark, d):
    """Every name is its own here, so all named points stay and the unnamed ones are tested against them."""
    return stage1.merged(synthetic.pois(spark, d)).where("name is null").select("id")


_FEW_NAMES = {"m_src": "select id as rid, osm_id, case when name is not null then 'N' || (key % 5) end as name, importance, category, lon, lat from poi"}
oracles.CTES.update(_FEW_NAMES)
oracles.NEEDS.update({"m_src": ("poi",), "m_named": ("m_src",), "m_greedy": ("m_named",), "m_kept": ("m_src", "m_greedy")})
oracles.CTES.update(extract.merge_ctes("m", "m_src"))


@query(needs("select rid as id, name, category from m_kept", "m_kept"))
def colocation_merge(spark, d):
    """With few names, so that named points fold, too."""
    return stage1.merged(synthetic.pois(spark, d).withColumn("name", F.when(F.col("name").isNotNull(), F.concat(F.lit("N"), (F.col("key") % 5).cast("string"))))).select("id", "name", "category")


# --- districts and promotion --------------------------------------------------------------------------------------


@query(needs("select id, district from near", "near"))
def nearest_anchor(spark, d):
    return promote.with_district(synthetic.pois(spark, d), synthetic.places(spark, d)).select("id", "district")


@query(needs("select id, standing, promoted from flag", "flag"))
def promotion_budget(spark, d):
    return _placed(spark, d).select("id", "standing", "promoted")


@query(needs("select id as pos, shown as name, category, named, district from minor", "minor"))
def minor_complement(spark, d):
    return _minors(spark, d).select("pos", "name", "category", "named", "district")


@query(needs("select rank, token, shown as name, importance from tok", "tok"))
def token_rank(spark, d):
    return _promoted(spark, d).select("rank", "token", "name", "importance")


# --- the graph ------------------------------------------------------------------------------------------------------


@query(needs("select src, dst from pair", "pair"))
def knn_graph(spark, d):
    return graph.knn_pairs(_promoted(spark, d), 3)


@query(needs("select src, ord, dst, meters from edge", "edge"))
def edge_order(spark, d):
    return _edges(spark, d).select("src", "ord", "dst", "meters")


@query(needs("select from_token, to_token, meters from edge where src < dst", "edge"))
def bidirectional_dedup(spark, d):
    return graph.one_way(_edges(spark, d)).select("from_token", "to_token", "meters")


@query(needs("select src, dst, crosses from crossed", "crossed"))
def crosses_barrier(spark, d):
    return _edges(spark, d).where("crosses is not null").select("src", "dst", "crosses")


@query(needs("select src, dst from wet", "wet"))
def separated_by_water(spark, d):
    return _edges(spark, d).where("separated_by_water").select("src", "dst")


@query(needs("select src from edge group by src having bool_and(separated_by_water)", "edge"))
def stands_apart(spark, d):
    return graph.stands_apart(_edges(spark, d))


_EDGE_COLUMNS = ("from_token", "to_token", "to_name", "meters", "dir", "bucket", "crosses", "separated_by_water")


@query(needs(f"select {', '.join(_EDGE_COLUMNS)} from edge", "edge"))
def flagship(spark, d):
    """Nearest anchors, the promotion budget, tokens, the proximity graph and what lies across its edges."""
    return _edges(spark, d).select(*_EDGE_COLUMNS)


# --- summaries ------------------------------------------------------------------------------------------------------


@query(needs("select * from main_street", "main_street"))
def dominant_street(spark, d):
    return summary.dominant(_promoted(spark, d), "district")


@query(needs("select district, count(*) as total, count(*) filter (where not named) as props, coalesce((select string_agg(n || case when c > 1 then ' ×' || c else '' end, ' · ' order by n) from (select arg_min(shown, id) as n, count(*) as c from minor m where m.named and m.district = minor.district group by upper(m.shown))), '') as named from minor group by district", "minor"))
def cluster_split(spark, d):
    rows = summary.cluster_split(_minors(spark, d), "district")
    return rows.select("district", "total", "props", F.array_join(F.transform("named", lambda n: text.counted(n["name"], n["count"])), " · ").alias("named"))


@query(needs("select district, spine_dir, cast(round_even(ux * 100, 0) as bigint) as ux100 from axis", "axis"))
def spine_axis(spark, d):
    return summary.axes(_promoted(spark, d), "district").select("district", F.col("direction").alias("spine_dir"), F.rint(F.col("axis.ux") * 100).cast("long").alias("ux100"))


@query(needs("select district, spine_dir, tokens from spine", "spine"))
def spine_order(spark, d):
    return summary.spine(_promoted(spark, d), 8).select("district", "spine_dir", F.array_join("spine_tokens", ",").alias("tokens"))


@query(needs("select row_number() over (order by count(*) desc, t.district) as ord, t.district as name, any_value(dominant_street) as street, any_value(s.spine_dir) as spine_dir, count(*) as promoted_count, coalesce(any_value(m.n), 0) as clustered_count, coalesce(any_value(m.props), 0) as prop_count from tok t left join main_street using (district) join spine s on s.district = t.district left join (select district, count(*) as n, count(*) filter (where not named) as props from minor group by district) m on m.district = t.district group by t.district", "tok", "main_street", "spine", "minor"))
def district_summary(spark, d):
    rows = summary.districts(*_both(spark, d), synthetic.places(spark, d), Options())
    return rows.select("ord", "name", "street", "spine_dir", "promoted_count", "clustered_count", "prop_count")


_TERRAIN = """(select kind, name, arg_min(geom_type, pos) as geom_type, arg_min(cls, pos) as cls, list(pos order by pos) as members, flatten(list(pts order by pos)) as flat, list(pts order by pos) as parts from shape group by kind, name)"""
_AREA = "list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i].lon * 111320e0 * cos(radians(r[1].lat)) * r[i % len(r) + 1].lat * 110540e0 - r[i % len(r) + 1].lon * 111320e0 * cos(radians(r[1].lat)) * r[i].lat * 110540e0))"


@query(needs(f"select row_number() over (order by case kind when 'water' then 1 when 'park' then 2 else 3 end, name) as ord, name, case when kind = 'barrier' then 'barrier:' || cls else kind end as kind_label, geom_type as geometry_type, len(members) as parts, len(flat) as vertices from {_TERRAIN}", "shape"))
def terrain_group(spark, d):
    rows = summary.terrain(synthetic.shapes(spark, d).withColumn("category", F.lit(None).cast("string")), synthetic.bounds())
    return rows.select("ord", "name", "kind_label", "geometry_type", F.size("parts").cast("long").alias("parts"), F.size(F.flatten("parts")).cast("long").alias("vertices"))


@query(needs(f"select name, kind, cast(round_even(area / 10, 0) as bigint) as area_10m2 from (select kind, name, geom_type, case when geom_type = 'Polygon' then list_sum(list_transform(parts, lambda r: abs({_AREA}) / 2)) else 0 end as area from {_TERRAIN}) where not (kind in ('water', 'park') and geom_type = 'Polygon' and area < 5000)", "shape"))
def terrain_area_filter(spark, d):
    rows = summary.terrain(synthetic.shapes(spark, d).withColumn("category", F.lit(None).cast("string")), synthetic.bounds())
    return summary.shown(rows, 5000.0).select("name", "kind", F.rint(F.col("area_m2") / 10).cast("long").alias("area_10m2"))


@query(document_oracles.TERRAIN_POSITION)
def terrain_position(spark, d):
    rows = summary.terrain(synthetic.shapes(spark, d).withColumn("category", F.lit(None).cast("string")), synthetic.bounds())
    return rows.select("kind", "name", "position")


# --- chunks -----------------------------------------------------------------------------------------------------------


def _model(spark, d) -> model.Model:
    return model.build(synthetic.features(spark, d), synthetic.meta(spark))


@query(needs(f"select id as pos, rank from (select m.id, p.rank, row_number() over (partition by m.id order by {haversine('m.lon', 'm.lat', 'p.lon', 'p.lat')}, p.rank) as rn from minor m cross join prom p) where rn = 1", "minor", "prom"))
def minor_to_chunk(spark, d):
    promoted, minors = _both(spark, d)
    points = promoted.select(F.col("rank").alias("ord"), "lon", "lat")
    return nearest_k(minors.select(F.col("pos").alias("id"), "lon", "lat"), points).select(F.col("id").alias("pos"), F.col("ord").alias("rank"))


def _district_homes(points: DataFrame) -> DataFrame:
    return points.select("rank", F.col("district").alias("chunk_ord"))


@query(needs("select here, there, dir, meters, via_token from (select a.district as here, b.district as there, dir, meters, to_token as via_token, row_number() over (partition by a.district, b.district order by meters, src, ord) as rn from edge join tok a on a.rank = src join tok b on b.rank = dst where a.district <> b.district) where rn = 1", "edge", "tok"))
def chunk_exits(spark, d):
    points = _promoted(spark, d)
    areas = points.select(F.col("district").alias("ord"), F.col("district").alias("name")).distinct()
    return chunking.exits(_edges(spark, d, points), _district_homes(points), areas).select("here", "there", "dir", "meters", "via_token")


@query(needs(f"select district, t.kind, t.name from (select district, min(lon) as w, min(lat) as s, max(lon) as e, max(lat) as n from tok group by district) a join (select kind, name, list_min(list_transform(flat, lambda p: p.lon)) as w, list_min(list_transform(flat, lambda p: p.lat)) as s, list_max(list_transform(flat, lambda p: p.lon)) as e, list_max(list_transform(flat, lambda p: p.lat)) as n from {_TERRAIN}) t on t.w <= a.e and t.e >= a.w and t.s <= a.n and t.n >= a.s", "tok", "shape"))
def chunk_terrain_overlap(spark, d):
    areas = _promoted(spark, d).groupBy("district").agg(F.array(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("bounds")).withColumnRenamed("district", "ord")
    rows = summary.terrain(synthetic.shapes(spark, d).withColumn("category", F.lit(None).cast("string")), synthetic.bounds())
    return chunking.local_terrain(rows, areas).select(F.col("chunk_ord").alias("district"), "kind", "name")


@query(needs("select district, n, case when m > 0 and widest >= 2 * m then cut else n // 2 end as cut from (select district, any_value(n) as n, list_sort(list(gap) filter (where gap is not null))[1 + (any_value(n) - 1) // 2] as m, max(gap) filter (where i between side and n - side) as widest, min_by(i, (-gap, i)) filter (where i between side and n - side) as cut from (select district, n, i, gap, greatest(2, n // 5) as side from (select district, count(*) over (partition by district) as n, row_number() over w - 1 as i, lon - lag(lon) over w as gap from tok window w as (partition by district order by lon, lat, rank))) group by district)", "tok"))
def gap_cut(spark, d):
    """One level of the bisection, along the longitude."""
    w = Window.partitionBy("district")
    rows = _promoted(spark, d).select(F.col("district").alias("group"), F.lit("").alias("path"), F.count(F.lit(1)).over(w).alias("n"), F.col("lon").alias("one"), (F.row_number().over(w.orderBy("lon", "lat", "rank")) - 1).cast("long").alias("i"))
    sizes = rows.select("group", "n").distinct()
    return partition.cuts(tables.materialise(rows, "gap-places"), False).join(sizes, "group").select(F.col("group").alias("district"), "n", F.col("cut").cast("long").alias("cut"))


@query(needs("""with p as (select district, cast(round_even(lon * 1e7, 0) as bigint) as x, cast(round_even(lat * 1e7, 0) as bigint) as y from tok), u as (select distinct * from p),
  e as (select a.district, a.x as px, a.y as py, b.x as qx, b.y as qy from u a join u b on a.district = b.district and (a.x, a.y) <> (b.x, b.y)),
  h as (select * from e where not exists (select 1 from u r where r.district = e.district and ((qx - px) * (r.y - py) - (qy - py) * (r.x - px) < 0
    or ((qx - px) * (r.y - py) - (qy - py) * (r.x - px) = 0 and ((r.x - px) * (qx - px) + (r.y - py) * (qy - py) < 0 or (r.x - qx) * (qx - px) + (r.y - qy) * (qy - py) > 0)))))
  select district, count(*) as corners, cast(sum(px::hugeint * qy - qx::hugeint * py) // 1000000 as bigint) as area from h group by district having count(*) > 2""", "tok").replace("with recursive ", "with recursive ", 1).replace(" with p as ", ", p as ", 1))
def district_hulls(spark, d):
    """The hull of every district's features, from parts: its corners, and twice its area."""
    whole = lambda axis: F.rint(F.col(axis) * 1e7)
    rows = _promoted(spark, d).select("district", F.array(geo.point(whole("lon"), whole("lat"))).alias("pts"))
    cross = lambda e: e["p"]["lon"].cast("decimal(20,0)") * e["q"]["lat"].cast("decimal(20,0)") - e["q"]["lon"].cast("decimal(20,0)") * e["p"]["lat"].cast("decimal(20,0)")
    area = F.aggregate(geo.edges_of(F.col("pts"), closed=False), F.lit(0).cast("decimal(38,0)"), lambda s, e: (s + cross(e)).cast("decimal(38,0)"))
    return stage1.hulls(rows, "district").select("district", (F.size("pts") - 1).cast("long").alias("corners"), F.floor(area / 1000000).cast("long").alias("area"))


@query(document_oracles.CHUNKS)
def bisect_chunks(spark, d):
    found = _model(spark, d)
    parts = model.partition(found, Options(chunking=True, scene_size=8))
    return parts.chunks.select("ord", "name", "slug", "anchor_token", F.array_join("tokens", ",").alias("tokens"))


@query(needs("select rank, component from (select rank, min(other) as component from reach group by rank)", "pair").replace("with recursive ", "with recursive ", 1).replace(" select rank, component from", ", reach(rank, other) as (select rank, rank from prom union select reach.rank, pair.dst from reach join pair on pair.src = reach.other) select rank, component from", 1))
def components(spark, d):
    points = _promoted(spark, d)
    return chunking.components(points, tables.materialise(graph.knn_pairs(points, 3), "pairs"))


@query(needs("select key, case when rn > 1 then slug || '-' || rn else slug end as slug from (select n_nationkey as key, slug, row_number() over (partition by slug order by n_nationkey) as rn from (select n_nationkey, 'area-' || (n_nationkey % 6) as slug from nation))"))
def slug_unique(spark, d):
    rows = synthetic.table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), text.slug(F.concat(F.lit("Area — "), (F.col("n_nationkey") % 6).cast("string"))).alias("slug"))
    return chunking.unique_slugs(rows).select(F.col("ord").alias("key"), "slug")


@query(needs(f"select rank, district || ' · ' || case when rn > 1 then oct || ' — ' || shown else oct end as chunk from (select *, row_number() over (partition by district, oct order by rank) as rn from (select t.*, {wind('clon', 'clat', 'lon', 'lat')} as oct from tok t join centre using (district)))", "tok", "centre"))
def octant_names(spark, d):
    """Names of pieces, every feature being one."""
    homes = tables.materialise(_promoted(spark, d).withColumn("group", F.col("district")).withColumn("base", F.col("district")).withColumn("path", F.col("rank").cast("string")), "octant-homes")
    return partition.names(homes).select(F.col("path").cast("long").alias("rank"), "chunk")


# --- text -------------------------------------------------------------------------------------------------------------


@query(needs("select src as rank, string_agg('   → ' || to_token || ' — ~' || meters || 'm ' || dir || case when meters >= 500 then ' (far)' else '' end || case when separated_by_water then ' [separated by water]' else '' end || coalesce(' [crosses ' || crosses || ']', '') || chr(10), '' order by ord) as arrows from edge where src < dst group by src", "edge"))
def render_connections(spark, d):
    return render.arrows(_edges(spark, d), Options())


@query(document_oracles.DOCUMENT)
def render_document(spark, d):
    return render.document(_model(spark, d), Options())


@query(document_oracles.SCENES)
def scene_chunks(spark, d):
    rows = model.scene_chunks(_model(spark, d), Options(chunking=True))
    return rows.withColumn("bounds", render.bounds_span(F.col("bounds"))).withColumn("tokens", F.array_join("tokens", ",")).withColumn("neighbours", F.array_join("neighbours", ","))


@query(document_oracles.MANIFEST)
def manifest_lines(spark, d):
    found = _model(spark, d)
    return render.manifest(model.scene_chunks(found, Options(chunking=True)), found.meta)
