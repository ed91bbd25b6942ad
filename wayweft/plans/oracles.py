"""DuckDB SQL for the engine's queries, over the synthetic geography of plans.synthetic.

Each query is a chain of common table expressions; `needs` gathers those it uses, in order.
"""

from __future__ import annotations

from ..operators import classify as k
from . import synthetic

D = "cast({} as double)".format


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def haversine(x1, y1, x2, y2) -> str:
    return f"2 * 6371000e0 * asin(least(1e0, sqrt(power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians({x2} - {x1}) / 2), 2))))"


def wind(x1, y1, x2, y2) -> str:
    deg = f"degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1}))))"
    return f"{_list(('N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'))}[1 + cast(round_even((({deg} + 360e0) % 360e0) / 45e0, 0) as int) % 8]"


def bucket(m) -> str:
    return f"case when {m} < 25 then 'adjacent' when {m} < 150 then 'near' when {m} < 500 then 'short walk' else 'far' end"


def round_m(m) -> str:
    return f"cast(round_even(({m}) / 5e0, 0) * 5 as int)"


def cross(ax, ay, bx, by, cx, cy, dx, dy) -> str:
    turn = lambda ox, oy, px, py, qx, qy: f"(({px} - {ox}) * ({qy} - {oy}) - ({py} - {oy}) * ({qx} - {ox}) > 0)"
    return f"({turn(cx, cy, dx, dy, ax, ay)} <> {turn(cx, cy, dx, dy, bx, by)} and {turn(ax, ay, bx, by, cx, cy)} <> {turn(ax, ay, bx, by, dx, dy)})"


def salience(category) -> str:
    sub = f"substr({category}, instr({category}, '.') + 1)"
    of = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    return (
        f"case when {category} like 'landmark.%' then case when {sub} in {of(k.BUDGETED_LANDMARK)} then 'budgeted' else 'core' end"
        f" when {category} like 'civic.%' then case when {sub} in {of(k.CORE_CIVIC)} then 'core' else 'budgeted' end"
        f" when {category} like 'leisure.%' then case when {sub} in {of(k.CORE_LEISURE)} then 'core' else 'budgeted' end"
        f" when {category} like 'residential.%' then 'clustered' else 'budgeted' end"
    )


def importance(category, named, chain) -> str:
    base = (
        f"case when {category} like 'landmark.%' then case when {salience(category)} = 'budgeted' then 45 else 80 end when {category} in ('civic.government') then 45"
        f" when {category} like 'civic.%' then case when {salience(category)} = 'budgeted' then 55 else 80 end when {category} like 'residential.%' then 30 else 55 end"
    )
    return f"greatest(0, least(100, {base} + case when {named} then 10 else 0 end + case when {category} like 'landmark.%' then 5 else 0 end - case when {chain} then 15 else 0 end))"


def tier(score) -> str:
    return f"case when {score} >= 75 then 'landmark' when {score} >= 50 then 'destination' when {score} >= 25 then 'minor' else 'structure' end"


def _category() -> str:
    whens = " ".join(f"when '{s}' then '{name}.' || {_list(subs)}[cast(key % 4 + 1 as int)]" for s, (name, subs) in synthetic.SEGMENTS.items())
    return f"case segment {whens} else 'civic.' || {_list(synthetic.CIVIC[1])}[cast(key % 4 + 1 as int)] end"


LON = f"{D('-120.5')} + (nation % 5) * 1e-2 + ((key * 37) % 997) * 1e-5"
LAT = f"{D('45.5')} + cast(floor(nation / 5) as int) * 1e-2 + ((key * 91) % 991) * 1e-5"


def _ring(lon, lat, half) -> str:
    return "[" + ", ".join(f"{{'lon': {lon} + {x}e0 * {half}, 'lat': {lat} + {y}e0 * {half}}}" for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))) + "]"


CTES = {
    "raw": "select c_custkey * 2 as id, c_custkey as key, 'n' || c_custkey as osm_id, c_name as label, c_nationkey as nation, c_mktsegment as segment from customer union all select s_suppkey * 2 + 1, s_suppkey, 's' || s_suppkey, s_name, s_nationkey, 'CIVIC' from supplier",
    "poi0": f"select *, {LON} as lon, {LAT} as lat, {_category()} as category, case when key % 7 <> 0 then label end as name from raw",
    "poi": f"select *, cast({importance('category', 'name is not null', 'key % 11 = 0')} as int) as importance, case when key % 2 = 0 then {salience('category')} end as salience, case when key % 9 <> 0 then 'Street ' || (key % 40) end as street, case when key % 3 = 0 then true end as street_approx from poi0",
    "place": f"select cast(n_nationkey as bigint) as pos, n_name as name, {D('-120.495')} + (n_nationkey % 5) * 1e-2 as lon, {D('45.505')} + cast(floor(n_nationkey / 5) as int) * 1e-2 as lat from nation",
    "shape": f"""select pos + 100 as pos, 'barrier' as kind, 'Route ' || (pos % 7) as name, 'LineString' as geom_type, case pos % 3 when 0 then 'motorway' when 1 then 'rail' else 'water' end as cls,
        [{{'lon': lon - 4e-3, 'lat': lat - 4e-3}}, {{'lon': lon, 'lat': lat + 1e-3}}, {{'lon': lon + 4e-3, 'lat': lat + 2e-3}}] as pts from place
      union all select pos + 200, 'water', 'Lake ' || (pos % 4), 'Polygon', null, {_ring('(lon + 1e-3)', '(lat + 1e-3)', '15e-4')} from place where pos % 2 = 0
      union all select pos + 300, 'park', 'Park ' || pos, 'Polygon', null, {_ring('(lon - 2e-3)', 'lat', '(1e-4 + 2e-4 * (pos % 4))')} from place""",
    "seg": "select pos, kind, name, cls, pts[i].lon as cx, pts[i].lat as cy, pts[i + 1].lon as dx, pts[i + 1].lat as dy from (select *, unnest(range(1, len(pts))) as i from shape)",
    "near": f"select id, district from (select poi.id, place.name as district, row_number() over (partition by poi.id order by {haversine('poi.lon', 'poi.lat', 'place.lon', 'place.lat')}, place.pos) as rn from poi cross join place) where rn = 1",
    "standing": f"""select poi.*, district, case when coalesce(salience, {salience('category')}) = 'clustered' then 'none' when name is null and category not in ('landmark.church') then 'none'
        when coalesce(salience, {salience('category')}) = 'core' then 'core' else 'budgeted' end as standing from poi join near using (id)""",
    "flag": "select *, standing = 'core' or (standing = 'budgeted' and row_number() over (partition by district, standing order by importance desc, osm_id, id) <= 20) as promoted from standing",
    "prom": "select *, row_number() over (order by importance desc, osm_id, id) as rank, coalesce(name, translate(substr(category, instr(category, '.') + 1), '_', ' ')) as shown from flag where promoted",
    "tok": "select *, '[' || lpad(cast(rank as varchar), cast(greatest(2, len(cast((select count(*) from prom) as varchar))) as int), '0') || ']' as token from prom",
    "minor": "select *, coalesce(name, translate(substr(category, instr(category, '.') + 1), '_', ' ')) as shown, name is not null as named from flag where not promoted",
    "knn": f"select src, dst from (select a.rank as src, b.rank as dst, row_number() over (partition by a.rank order by {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')}, b.rank) as rn from prom a join prom b on a.rank <> b.rank) where rn <= 3",
    "pair": "select src, dst from knn union select dst, src from knn",
    "ends": f"select src, dst, a.lon as ax, a.lat as ay, b.lon as bx, b.lat as by_, a.token as from_token, b.token as to_token, b.shown as to_name, {haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} as exact from pair join tok a on a.rank = src join tok b on b.rank = dst",
    "crossed": f"select src, dst, min(name) as crosses from ends join seg on kind = 'barrier' and cls <> 'water' and {cross('ax', 'ay', 'bx', 'by_', 'cx', 'cy', 'dx', 'dy')} group by src, dst",
    "inside": "select rank from (select p.rank, s.pos, count(*) as n from prom p join seg s on s.kind = 'water' and (s.dy > p.lat) <> (s.cy > p.lat) and p.lon < (s.cx - s.dx) * (p.lat - s.dy) / (s.cy - s.dy) + s.dx group by p.rank, s.pos) where n % 2 = 1 group by rank",
    "wet": f"select distinct src, dst from ends join seg on (kind = 'water' or cls = 'water') and {cross('ax', 'ay', 'bx', 'by_', 'cx', 'cy', 'dx', 'dy')} union select src, dst from ends where src in (select rank from inside) or dst in (select rank from inside)",
    "edge": f"""select src, dst, row_number() over (partition by src order by exact, dst) as ord, from_token, to_token, to_name, {round_m('exact')} as meters, {wind('ax', 'ay', 'bx', 'by_')} as dir, {bucket('exact')} as bucket, crosses, wet.src is not null as separated_by_water
        from ends left join crossed using (src, dst) left join wet using (src, dst)""",
    "street_n": "select district, street, count(*) as n from tok where street is not null group by all",
    "main_street": "select district, street as dominant_street from (select *, row_number() over (partition by district order by n desc, street) as rn from street_n) where rn = 1",
    "centre": "select district, count(*) as n, avg(lon) as clon, avg(lat) as clat from tok group by district",
    "local": "select tok.*, n, (lon - clon) * 111320e0 * cos(radians(clat)) as x, (lat - clat) * 110540e0 as y from tok join centre using (district)",
    "sums": "select district, any_value(n) as n, sum(x * x) as sxx, sum(y * y) as syy, sum(x * y) as sxy from local group by district",
    "axis0": "select district, n, cos(5e-1 * atan2(2 * sxy, sxx - syy)) as ux, sin(5e-1 * atan2(2 * sxy, sxx - syy)) as uy from sums",
    "axis1": "select district, n, case when uy < -1e-9 or (abs(uy) <= 1e-9 and ux < 0) then -ux else ux end as ux, case when uy < -1e-9 or (abs(uy) <= 1e-9 and ux < 0) then -uy else uy end as uy from axis0",
    "axis": "select district, ux, uy, case when n <= 1 or abs(degrees(atan2(ux, uy))) < 225e-1 then 'N–S' when abs(degrees(atan2(ux, uy))) >= 675e-1 then 'E–W' when degrees(atan2(ux, uy)) > 0 then 'NE–SW' else 'NW–SE' end as spine_dir from axis1",
    "keyed": "select local.*, row_number() over (partition by district order by importance desc, rank) as k from local",
    "spine": "select district, any_value(spine_dir) as spine_dir, string_agg(token, ',' order by x * ux + y * uy desc, rank) as tokens from keyed join axis using (district) where k <= 8 group by district",
    "ref": "select l_orderkey as way, l_partkey as node, l_linenumber, l_suppkey, l_quantity, l_extendedprice from lineitem",
    "node": f"select p_partkey as node, {D('-120.5')} + (p_partkey % 97) * 3e-4 + ((p_partkey * p_partkey * 31 + p_partkey) % 1009) * 1e-7 as lon, {D('45.5')} + (p_partkey % 89) * 3e-4 + ((p_partkey * p_partkey * 17 + p_partkey) % 997) * 1e-7 as lat from part where p_partkey % 13 <> 0",
    "vertex": "select way, lon, lat, row_number() over (partition by way order by l_linenumber, node, l_suppkey, l_quantity, l_extendedprice) as i, count(*) over (partition by way) as n from ref join node using (node)",
    "hop": "select a.way, a.i, a.n, a.lon as px, a.lat as py, b.lon as qx, b.lat as qy from vertex a join vertex b on a.way = b.way and b.i = a.i % a.n + 1",
    "road": "select way, i - 1 as seq, 'Way ' || (way % 50) as street, px as x1, py as y1, qx as x2, qy as y2 from hop where i < n",
}

NEEDS = {
    "poi0": ("raw",), "poi": ("poi0",), "shape": ("place",), "seg": ("shape",), "near": ("poi", "place"), "standing": ("near",), "flag": ("standing",), "prom": ("flag",), "tok": ("prom",), "minor": ("flag",), "knn": ("prom",), "pair": ("knn",), "ends": ("pair", "tok"),
    "crossed": ("ends", "seg"), "inside": ("prom", "seg"), "wet": ("ends", "seg", "inside"), "edge": ("ends", "crossed", "wet"), "street_n": ("tok",), "main_street": ("street_n",), "centre": ("tok",), "local": ("centre", "tok"), "sums": ("local",), "axis0": ("sums",), "axis1": ("axis0",), "axis": ("axis1",),
    "keyed": ("local",), "spine": ("keyed", "axis"), "vertex": ("ref", "node"), "hop": ("vertex",), "road": ("hop",),
}


def needs(select: str, *names: str) -> str:
    """select, with the expressions it names and all they need before it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for one in NEEDS.get(name, ()):
            add(one)
        order.append(name)

    for name in names:
        add(name)
    if not order:
        return select
    # what several later expressions read is worth computing once
    return "with recursive " + ", ".join(f"{name} as materialized ({CTES[name]})" for name in order) + " " + select
