"""Queries over the synthetic map extract: the first stage from XML to the contract, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options, tables
from ..functions import geo, text
from ..operators import chunks, graph, labels, render, stage1, view
from ..operators.promote import numbered
from ..options import Options
from ..sources import geojson, osm, writers
from . import document_oracles, extract, model, normalize, oracles, synthetic
from .oracles import needs
from .queries import _both, _edges, _model, _promoted, _ways, query

oracles.CTES.update(extract.CTES)
oracles.NEEDS.update(extract.NEEDS)


def _fifth(value, places: str = "100000"):
    """A coordinate as a whole number of 1e-5 degrees, off the ties."""
    return F.rint(value * float(places) + 0.137).cast("long")


_FIFTH = "cast(round_even(({}) * 100000 + 137e-3, 0) as bigint)".format
_WAY_ID = "pos * 10 + w + 40000000"


@query(needs(f"""select 'node' as kind, p_partkey as id, cast((p_partkey % 6 < 5)::int + (p_partkey % 5 < 2)::int + (p_size % 7 = 0)::int + (p_partkey % 10 = 3)::int + (p_size % 3 <> 0)::int + (p_size % 5 = 0)::int + (p_partkey % 8 = 0)::int as bigint) as n_tags, 0::bigint as n_parts from part where p_partkey % 13 <> 0
  union all select 'node', pos * 100 + j + 10000000, 0, 0 from x_corner union all select 'node', pos + 20000000, 2, 0 from place
  union all select 'way', way, case when way % 5 = 2 then 3 else 2 end, count(*) from ref group by way union all select 'way', {_WAY_ID}, case w when 1 then 2 when 2 then 3 when 3 then 2 else 0 end, count(*) from x_line group by pos, w
  union all select 'relation', pos + 60000000, 3, case pos % 3 when 0 then 4 when 1 then 1 else 2 end from place""", "place", "ref", "x_line"))
def osm_scan(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, ways and relations that are admitted, from XML."""
    found = osm.scan(spark, extract.write(spark, d))
    flat = lambda rows, kind, parts: rows.select(F.lit(kind).alias("kind"), "id", F.size("tags").cast("long").alias("n_tags"), parts.cast("long").alias("n_parts"))
    return flat(found.nodes, "node", F.lit(0)).union(flat(found.ways, "way", F.size("nds"))).union(flat(found.relations, "relation", F.size("members")))


def _lines(found: osm.Scan) -> DataFrame:
    return stage1.way_points(found.ways.withColumn("key", F.col("pos")), osm.node_points(found.nodes)).drop("key")


def _scan(spark: SparkSession, d: str) -> osm.Scan:
    return osm.scan(spark, extract.write(spark, d))


def _contract(spark: SparkSession, d: str) -> DataFrame:
    """The contract of the extract; a folder of many parts has no order of its own, so rows have that of their ids."""
    found = _scan(spark, d)
    ordered = lambda rows: rows.withColumn("pos", F.col("id"))
    return stage1.features(ordered(found.nodes), ordered(found.ways), ordered(found.relations))


@query(needs(f"select way as id, count(*) as n, {_FIFTH('arg_min(lon, i)')} as first_lon, {_FIFTH('arg_max(lat, i)')} as last_lat from vertex group by way union all select {_WAY_ID}, count(*), {_FIFTH('arg_min(lon, i)')}, {_FIFTH('arg_max(lat, i)')} from x_line group by pos, w union all select distinct way, 0, null::bigint, null::bigint from ref where way not in (select way from vertex)", "vertex", "x_line"))
def osm_way_points(spark, d):
    pts = F.col("pts")
    return _lines(_scan(spark, d)).select("id", F.size(pts).cast("long").alias("n"), _fifth(F.get(pts, F.lit(0))["lon"]).alias("first_lon"), _fifth(F.try_element_at(pts, F.lit(-1))["lat"]).alias("last_lat"))


@query(needs("select arg_min(name, pos) || ' & ' || (select name from place order by pos limit 1 offset 1) as title, (select min(lon) from (select lon from node union all select lon from x_corner union all select lon from place)) as west, (select min(lat) from (select lat from node union all select lat from x_corner union all select lat from place)) as south, (select max(lon) from (select lon from node union all select lon from x_corner union all select lon from place)) as east, (select max(lat) from (select lat from node union all select lat from x_corner union all select lat from place)) as north from place", "node", "x_corner"))
def title_bounds(spark, d):
    """The nodes in the order of their ids, as files have them, since a folder of many parts has no order of its own."""
    nodes = _scan(spark, d).nodes.withColumn("pos", F.col("id"))
    b = F.col("bounds")
    return stage1.meta(nodes).select("title", b[0].alias("west"), b[1].alias("south"), b[2].alias("east"), b[3].alias("north"))


_POI = "osm_id, name, category, importance, tier, salience"


@query(needs(f"select {_POI}, {_FIFTH('lon')} as lon5, {_FIFTH('lat')} as lat5 from x_poi", "x_poi"))
def osm_pois(spark, d):
    """Points of interest of nodes and ways: names, classes, scores, representative points and the bonus of halls."""
    found = _scan(spark, d)
    return stage1.poi_rows(found.nodes, _lines(found)).select(*_POI.split(", "), _fifth(F.col("lon")).alias("lon5"), _fifth(F.col("lat")).alias("lat5"))


@query(needs("select osm_id, street, street_approx from x_placed", "x_placed"))
def osm_streets(spark, d):
    """Given streets, and the nearest road's where none is given."""
    found = _scan(spark, d)
    lines = tables.materialise(_lines(found).withColumn("pos", F.col("id")), "way-points")
    pois = tables.materialise(stage1.poi_rows(found.nodes, lines).withColumn("id", F.xxhash64("osm_id")), "pois")
    return stage1.with_street(pois, stage1.roads(lines)).select("osm_id", "street", "street_approx")


_SHAPE = f"kind, osm_id, name, cls, geom_type, cast(n as bigint) as n, {_FIFTH('west')} as west5, {_FIFTH('south')} as south5"


def _shapes(rows, kind, cls):
    low = lambda axis: _fifth(F.array_min(F.transform("pts", lambda p: p[axis])))
    return rows.select(kind.alias("kind"), "osm_id", "name", cls.cast("string").alias("cls"), "geom_type", F.size("pts").cast("long").alias("n"), low("lon").alias("west5"), low("lat").alias("south5"))


@query(needs(f"select {_SHAPE} from x_shape where osm_id not like 'r%'", "x_shape"))
def osm_places_barriers_areas(spark, d):
    found = _scan(spark, d)
    lines, none = _lines(found), F.lit(None)
    return _shapes(stage1.place_rows(found.nodes), F.lit("place"), none).union(_shapes(stage1.barrier_rows(lines), F.lit("barrier"), F.col("cls"))).union(_shapes(stage1.area_rows(lines), F.col("of"), none))


@query(needs(f"select {_SHAPE} from x_shape where osm_id like 'r%'", "x_shape"))
def osm_multipolygons(spark, d):
    """Rings stitched from their ways, open shores, and hulls where there is neither."""
    found = _scan(spark, d)
    tag = stage1.classify.tags_of()
    multi = found.relations.select("id", stage1.classify.area_of(tag).alias("kind"), F.col("tags")["name"].alias("name"), "members")
    rows = stage1.relation_shapes(multi, osm.last_by_id(_lines(found).select("id", "pos", "pts")), osm.node_points(found.nodes))
    return _shapes(rows, F.col("kind"), F.lit(None))


@query(needs(f"select row_number() over (order by osm_id, kind) as pos, kind, osm_id, name, category, importance, tier, salience, street, street_approx, barrier_class, geom_type, cast(n as bigint) as n, {_FIFTH('west')} as west5, {_FIFTH('south')} as south5 from x_all", "x_all"))
def osm_contract(spark, d):
    """The whole first stage: scan, classification, streets, merging, terrain, union and order."""
    rows = _contract(spark, d)
    low = lambda axis: _fifth(F.array_min(F.transform("pts", lambda p: p[axis])))
    return rows.select("pos", "kind", "osm_id", "name", "category", "importance", "tier", "salience", "street", "street_approx", "barrier_class", "geom_type", F.size("pts").cast("long").alias("n"), low("lon").alias("west5"), low("lat").alias("south5"))


@query(needs("select kind, count(*) as n from x_all group by kind", "x_all"))
def kind_counts(spark, d):
    return writers.counts_by_kind(normalize.from_osm(spark, extract.write(spark, d))[0])



@query(needs(f"select way, {_FIFTH('lon')} as lon5, {_FIFTH('lat')} as lat5, cast(n + (case when sx = 0 and sy = 0 then 0 else 1 end) as bigint) as closed_n, bonus from (select way, n, case when closed and n >= 4 and a2 <> 0 then fx + mx / (3 * a2) else ax end as lon, case when closed and n >= 4 and a2 <> 0 then fy + my / (3 * a2) else ay end as lat from x_ring) join (select way, arg_max(lon, i) - arg_min(lon, i) as sx, arg_max(lat, i) - arg_min(lat, i) as sy from vertex group by way) using (way) join (select way, case when a <= 200 then 0 else cast(least(9, round_even(5 * log10(a / 200), 0)) as int) end as bonus from (select way, case when any_value(n) >= 3 then abs(sum(px * k * qy * 111320e0 - qx * k * py * 111320e0)) / 2 else 0 end as a from (select *, 111320e0 * cos(radians(avg(py) over (partition by way))) as k from hop) group by way)) using (way)", "x_ring"))
def way_representatives(spark, d):
    """Representative point, closed ring and area bonus of every way."""
    pts = F.col("pts")
    rows = _ways(spark, d).select("way", geo.representative_point(pts).alias("pt"), F.size(geo.closed_ring(pts)).cast("long").alias("closed_n"), stage1.classify.area_bonus(geo.footprint_m2(pts)).alias("bonus"))
    return rows.select("way", _fifth(F.col("pt.lon")).alias("lon5"), _fifth(F.col("pt.lat")).alias("lat5"), "closed_n", "bonus")


@query(needs(f"select kind, osm_id, name, category, importance, tier, salience, street, street_approx, barrier_class, geom_type, cast(n as bigint) as n, {_FIFTH('west')} as west5, {_FIFTH('south')} as south5, 'Lattice' as title from x_all", "x_all"))
def contract_lines(spark, d):
    """The contract written one feature a line and scanned again: points, lines and outer rings decoded from JSON."""
    rows = _contract(spark, d)
    lines = tables.folder(spark, "contract-lines")
    writers.write_lines(rows, synthetic.meta(spark), lines)
    found, meta = geojson.read_lines(spark, lines)
    low = lambda axis: _fifth(F.array_min(F.transform("pts", lambda p: p[axis])))
    shown = found.select("kind", "osm_id", "name", "category", "importance", "tier", "salience", "street", "street_approx", "barrier_class", "geom_type", F.size("pts").cast("long").alias("n"), low("lon").alias("west5"), low("lat").alias("south5"))
    return shown.crossJoin(F.broadcast(meta.select("title")))  # one row


@query(needs("select rank, dense_rank() over (order by n desc, component) as grp, 'Around ' || top as base from (select rank, component, count(*) over (partition by component) as n, first_value(shown) over (partition by component order by importance desc, rank) as top from (select rank, min(other) as component from reach group by rank) join prom using (rank))", "pair").replace("with recursive ", "with recursive ", 1).replace(" select rank, dense_rank()", ", reach(rank, other) as (select rank, rank from prom union select reach.rank, pair.dst from reach join pair on pair.src = reach.other) select rank, dense_rank()", 1))
def component_groups(spark, d):
    """Groups of scene chunks where there are no districts."""
    points = _promoted(spark, d)
    pairs = tables.materialise(graph.knn_pairs(points, 3), "pairs")
    none = points.select(F.col("district").alias("name"), F.lit(1).alias("ord")).limit(0)
    return chunks.groups(points, pairs, none).select("rank", F.col("group").cast("long").alias("grp"), "base")


@query("""select c_custkey as id, given and c_custkey % 2 = 0 as bidirectional, given and c_custkey % 13 < 6 as inline_name, not given or c_custkey % 7 < 3 as preamble, given and c_custkey % 3 = 1 as chunking, given and c_custkey % 11 < 5 as minor_features,
  case when given and c_custkey % 4 = 0 then 8 when given and c_custkey % 4 = 2 then 22 else 14 end as scene_size from (select *, c_custkey % 5 > 1 as given from customer)""")
def options_json(spark, d):
    """Options from JSON texts: none, blank ones, keys of any case, values of other types and unknown labels."""
    k = F.col("c_custkey")
    flag = lambda name, on: F.concat(F.lit(f'"{name}": '), on.cast("string"), F.lit(", "))
    label = F.element_at(F.array(*map(F.lit, ("tight", "standard", "wide", "huge"))), (k % 4 + 1).cast("int"))
    chunking = F.concat(F.lit('"CHUNKING": '), F.when(k % 3 == 0, '"yes"').otherwise((k % 3 == 1).cast("string")), F.lit(", "))
    given = F.concat(F.lit("{"), flag("Bidirectional", k % 2 == 0), flag("inlineNeighborName", k % 13 < 6), flag("directivePreamble", k % 7 < 3), chunking, flag("minorfeatures", k % 11 < 5), F.lit('"sceneSize": "'), label, F.lit('"}'))
    rows = synthetic.table(spark, d, "customer").select(k.alias("id"), options.parsed(F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "  ").otherwise(given)).alias("o"))
    return rows.select("id", "o.*")


@query(needs(f"select id, round_even(lon * 1e7, 0) / 1e7 as lon7, rtrim(rtrim(printf('%.4f', lat), '0'), '.') as lat4 from poi", "poi"))
def coordinate_text(spark, d):
    """Coordinates rounded to seven places, and written with up to four."""
    return synthetic.pois(spark, d).select("id", geo.round7("lon").alias("lon7"), text.decimals4("lat").alias("lat4"))


@query(needs("select id, cast(round_even((800 - sx * scale) / 2 + (lon + 1205e-1) * squeeze * scale + 137e-3, 0) as bigint) as x, cast(round_even((600 - sy * scale) / 2 + (4555e-2 - lat) * scale + 137e-3, 0) as bigint) as y from (select *, least((800 - 48) / sx, (600 - 48) / sy) as scale from (select id, lon, lat, squeeze, 5e-2 * squeeze as sx, 5e-2 as sy from (select *, cos(radians(45525e-3)) as squeeze from poi)))", "poi"))
def view_fit(spark, d):
    """Places in a view of 800 by 600, north up."""
    at = geo.equirectangular_fit("lon", "lat", synthetic.bounds(), 800.0, 600.0)
    return synthetic.pois(spark, d).select("id", at.alias("at")).select("id", F.rint(F.col("at.x") + 0.137).cast("long").alias("x"), F.rint(F.col("at.y") + 0.137).cast("long").alias("y"))


_LABEL = """label as (select rank, name, x, y, 6 * length(name) as w, row_number() over (order by rank % 97 = 0 desc, importance desc, rank) as nth, rank % 97 = 0 as forced from (select rank, shown as name, importance,
    cast(round_even((800 - sx * scale) / 2 + (lon + 1205e-1) * squeeze * scale + 137e-3, 0) as bigint) as x, cast(round_even((600 - sy * scale) / 2 + (4555e-2 - lat) * scale + 137e-3, 0) as bigint) as y
    from (select *, least((800 - 48) / sx, (600 - 48) / sy) as scale from (select *, 5e-2 * squeeze as sx, 5e-2 as sy from (select *, cos(radians(45525e-3)) as squeeze from tok))))),
  greedy(nth, kept) as (select 0::bigint, []::struct(x bigint, y bigint, w bigint)[] union all
    select g.nth + 1, case when l.forced or len(list_filter(g.kept, lambda k: k.x < l.x + l.w and l.x < k.x + k.w and k.y < l.y + 12 and l.y < k.y + 12)) = 0 then list_append(g.kept, {'x': l.x, 'y': l.y, 'w': l.w}) else g.kept end from greedy g join label l on l.nth = g.nth + 1)"""


@query(needs("select rank, x, y from label join (select nth, len(kept) > len(lag(kept) over (order by nth)) as stays from greedy) using (nth) where stays", "tok").replace(" select rank, x, y from label", f", {_LABEL} select rank, x, y from label", 1))
def label_places(spark, d):
    """Which names of features have room in a view of 800 by 600."""
    at = geo.equirectangular_fit("lon", "lat", synthetic.bounds(), 800.0, 600.0)
    rows = _promoted(spark, d).select("rank", "name", "importance", at.alias("at"))
    boxes = rows.select("rank", F.col("rank").alias("token"), F.rint(F.col("at.x") + 0.137).cast("long").alias("x"), F.rint(F.col("at.y") + 0.137).cast("long").alias("y"), (F.length("name") * 6).alias("width"), F.lit(12).alias("height"), (F.col("rank") % 97 == 0).alias("forced"), "importance")
    return labels.placed(boxes).select("rank", "x", "y")


@query(needs("select dst as token_rank, string_agg(src, ',' order by src) as neighbours from pair group by dst", "pair"))
def neighbours_of(spark, d):
    """The neighbours of every feature, as a detail view lists them."""
    points = _promoted(spark, d)
    rows = graph.knn_pairs(points, 3).groupBy(F.col("src").alias("token_rank")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("neighbours"))
    return rows


@query(needs("select least(src, dst) as one, greatest(src, dst) as other from pair group by all", "pair"))
def undirected_pairs(spark, d):
    """Each drawable edge once."""
    pairs = graph.knn_pairs(_promoted(spark, d), 3).withColumn("ord", F.lit(1))
    return graph.one_way(pairs).select(F.col("src").alias("one"), F.col("dst").alias("other"))


@query(needs("select t.rank, token, shown as name, category, street, district, importance, neighbours from tok t left join (select src as rank, string_agg(to_token || ' ' || to_name || ' — ' || meters || 'm ' || dir || ' · ' || bucket, chr(10) order by ord) as neighbours from edge group by src) using (rank)", "tok", "edge"))
def feature_details(spark, d):
    points = _promoted(spark, d)
    return view.details(points, _edges(spark, d, points)).drop("tier")


@query(needs("select least(src, dst) as one, greatest(src, dst) as other, arg_min(meters, (src, ord)) as meters from edge where src % 10 > 0 and dst % 10 > 0 group by all", "edge"))
def drawable_edges(spark, d):
    """With every tenth feature hidden, the edges that can still be drawn."""
    points = _promoted(spark, d)
    return view.drawable(_edges(spark, d, points), points.where("rank % 10 > 0"))


@query(needs("select id as pos, shown as name, case when named then 'minors' else 'props' end as layer from minor", "minor"))
def minor_layers(spark, d):
    return view.layers(_both(spark, d)[1]).select("pos", "name", "layer")


_BOX_OF = "(select coalesce(min(lon), -1e0) as west, coalesce(min(lat), -1e0) as south, coalesce(max(lon), 1e0) as east, coalesce(max(lat), 1e0) as north from ({}))".format
_EVERYWHERE = "select lon, lat from prom union all select lon, lat from minor union all select p.lon, p.lat from (select unnest(pts) as p from shape)"


@query(needs(f"select 'all' as of, * from {_BOX_OF(_EVERYWHERE)} union all select 'none', * from {_BOX_OF('select lon, lat from prom where false')}", "prom", "minor", "shape"))
def view_bounds(spark, d):
    """The box of everything a view shows, and that of nothing."""
    promoted, minors = _both(spark, d)
    shapes = synthetic.features(spark, d).where("kind not in ('poi', 'place')").select(F.explode("pts").alias("p")).select("p.lon", "p.lat")
    named = lambda of, box: box.select(F.lit(of).alias("of"), "*")
    return named("all", view.bounds_of(promoted, minors, shapes)).union(named("none", view.bounds_of(promoted.limit(0))))


@query(needs("select unnest(tokens) as token, slug from aslug", "aslug"))
def token_chunks(spark, d):
    """The chunk that a view opens for each feature."""
    parts = model.partition(_model(spark, d), Options(chunking=True, scene_size=8))
    return view.chunk_of_token(parts.chunks)


@query(f"select cast(row_number() over (order by section, ord, i) as bigint) as line, text from (select section, ord, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as text from (select section, ord, string_split(text[:-2], chr(10)) as ls from ({document_oracles.DOCUMENT})))")
def document_parts(spark, d):
    """The whole document written by many tasks and read again in its order."""
    path = tables.folder(spark, "document")
    writers.write_text(render.document(_model(spark, d), Options()), path, rows_a_part=200)
    return numbered(writers.read_text(spark, path), [F.asc("part"), F.asc("at")], "line").select("line", "text")


@query(f"select slug, markdown from ({document_oracles.SCENES})")
def chunk_files(spark, d):
    """Every chunk's document written to a file of its own and read again."""
    path = tables.folder(spark, "chunks")
    writers.chunk_folders(model.scene_chunks(_model(spark, d), Options(chunking=True)), path)
    return writers.read_chunks(spark, path)
