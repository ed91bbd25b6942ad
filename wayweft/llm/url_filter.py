"""URL filters by a temporal list join.

Dated list entries (a list's name, a scope, a key, add or remove, and a time) become validity intervals: an added
entry holds until the next dated entry of the same list, scope and key. Every capture (a URL with its fetch time)
is then joined, as of its fetch time, with the entries active at that moment. Scopes: `host` (that host), `domain`
(that host and all below it) and `prefix` (host and path up to a slash or the end; closing slashes do not count, and
the path keeps its case). A capture meets the lists under its own host, each of its host's parents, of which there are
at most 127, and the heads of its path of those depths that occur in the list.

Intervals are broadcast while their number, counted first, is at most BROADCAST_ROWS; beyond that they are shuffled
by scope and key, and the session's skew join splits hot hosts.

Results: one row per capture. A null, relative or malformed URL has a null host and meets no list, nor does a capture
without a fetch time. Entries with a null in list, scope, key, action or time are void; of entries of one time a
removal counts last; repeated entries count once. Repeated captures are rows of their own. An empty list leaves
every capture unblocked; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"

# A list history for the synthetic pages, as (list, scope, key, action, epoch second). 2024-01-01 is 1704067200.
_DAY, _START = 86_400, 1_704_067_200
HISTORY = [
    (name, scope, key, action, _START + day * _DAY)
    for name, scope, key, action, day in (
        ("spam", "host", "spam-farm.example.org", "add", 30),
        ("spam", "host", "spam-farm.example.org", "remove", 150),
        ("spam", "host", "spam-farm.example.org", "add", 200),
        ("spam", "host", "www.cheap-pills.example.com", "add", 0),
        ("pharma", "domain", "cheap-pills.example.com", "add", 60),
        ("pharma", "domain", "cheap-pills.example.com", "remove", 300),
        ("adult", "domain", "ththth.example.org", "add", 120),
        ("mirror", "domain", "example.net", "add", 250),
        ("mirror", "domain", "example.net", "remove", 260),
        ("mirror", "host", "m.ththth.example.net", "add", 10),
        ("legal", "prefix", "tionsh.example.net/en", "add", 45),
        ("legal", "prefix", "tionsh.example.net/en", "remove", 180),
        ("legal", "prefix", "thther.example.org/fr", "add", 0),
        ("malware", "host", "thther.example.com", "add", 90),
        ("malware", "host", "thther.example.com", "add", 95),
        ("malware", "host", "thther.example.com", "remove", 95),
        ("malware", "domain", "tiontion.example.com", "add", 20),
        ("Mixed", "prefix", "Tion.example.ORG/en/", "add", 75),
        ("Mixed", "prefix", "tionsh.example.net/EN", "add", 5),
        ("whole", "prefix", "thth.example.net/", "add", 100),
    )
]


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and last dot; null if there is none."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.nullif(F.lower(host), F.lit(""))


def entries(spark: SparkSession, rows: list[tuple] = HISTORY) -> DataFrame:
    return spark.createDataFrame(rows, "list string, scope string, key string, action string, at long")


def intervals(dated: DataFrame) -> DataFrame:
    """list, scope, key, since and until (exclusive; null: open) of every added entry."""
    # a path keeps its case
    host = F.lower(F.regexp_extract("key", "^[^/]*", 0))
    path = F.regexp_replace(F.regexp_extract("key", "(?s)/.*$", 0), "/+$", "")
    key = F.when(F.col("scope") == "prefix", F.concat(host, path)).otherwise(F.lower("key"))
    clean = dated.select("list", "scope", key.alias("key"), "action", F.col("at").cast("long").alias("at")).dropna().where(F.col("action").isin("add", "remove")).distinct()
    order = Window.partitionBy("list", "scope", "key").orderBy("at", "action")
    return clean.withColumn("until", F.lead("at").over(order)).where("action = 'add'").select("list", "scope", "key", F.col("at").alias("since"), "until")


def keys_of(host: Column, url: Column, depths: list[int]) -> Column:
    """Every (scope, key) under which a list may have the URL; depths: numbers of path parts of its prefixes."""
    parts = F.split(F.substring_index(host, ".", -127), r"\.")  # a host name has no more labels
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "^/|/+$", "")
    named = lambda scope, keys: F.transform(keys, lambda k: F.struct(F.lit(scope).alias("scope"), k.alias("key")))
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")
    fits = F.filter(known, lambda d: d <= F.when(path == "", F.lit(0)).otherwise(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1))
    prefixes = F.transform(fits, lambda d: F.when(d == 0, host).otherwise(F.concat(host, F.lit("/"), F.call_function("substring_index", path, F.lit("/"), d))))
    return F.array_distinct(F.concat(F.array(F.struct(F.lit("host").alias("scope"), host.alias("key"))), named("domain", domains), named("prefix", prefixes)))


def filter_captures(captures: DataFrame, dated: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures(page_id, url, fetched): page_id, host, fetched, blocked, n_active and matches (comma-joined list:scope:key)."""
    active = intervals(dated)
    # the depths of its prefixes, a few small numbers
    depths = sorted(r[0] for r in active.where("scope = 'prefix'").select((F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))).alias("depth")).distinct().collect())
    if active.limit(broadcast_rows + 1).count() <= broadcast_rows:
        active = F.broadcast(active)
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("fetched").cast("long").alias("fetched")).withColumn("host", host_of(F.col("url")))
    probes = rows.select("row", "page_id", "host", "fetched", F.explode_outer(keys_of(F.col("host"), F.col("url"), depths)).alias("probe")).select("row", "page_id", "host", "fetched", F.col("probe.scope").alias("scope"), F.col("probe.key").alias("key"))
    in_time = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    a = active.select(F.col("list").alias("_list"), F.col("scope").alias("_scope"), F.col("key").alias("_key"), "since", "until")
    met = probes.join(a, (F.col("scope") == F.col("_scope")) & (F.col("key") == F.col("_key")) & in_time, "left")
    name = F.concat_ws(":", "_list", "scope", "key")
    grouped = met.groupBy("row", "page_id", "host", "fetched").agg(F.count("_list").alias("n_active"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_list").isNotNull(), name))), ",").alias("matches"))
    return grouped.select("page_id", "host", "fetched", (F.col("n_active") > 0).alias("blocked"), "n_active", "matches")


def captures_of(pages: DataFrame) -> DataFrame:
    """The synthetic pages have no fetch time; each gets one in 2024 by its number."""
    return pages.select("page_id", "url", (F.lit(_START) + F.pmod(F.col("page_id") * 86_413, F.lit(366 * _DAY))).alias("fetched"))


def oracle() -> str:
    """filter_captures(captures_of(pages), HISTORY) in DuckDB SQL."""
    values = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e})" for a, b, c, d, e in HISTORY)
    return f"""
with dated as (select distinct list, scope, case when scope = 'prefix' then lower(split_part(key, '/', 1)) || regexp_replace(substr(key, length(split_part(key, '/', 1)) + 1), '/+$', '') else lower(key) end as key, action, since from (values {values}) v(list, scope, key, action, since)),
ordered as (select *, lead(since) over (partition by list, scope, key order by since, action) as until from dated),
p as (select page_id, url, {_START} + (page_id * 86413) % {366 * _DAY} as fetched,
      nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '{_AUTHORITY}', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '')), '') as host,
      string_split(regexp_replace(regexp_extract(url, '{_PATH}', 1), '^/|/+$', '', 'g'), '/') as path from pages),
hit as (select p.page_id, p.url, o.list || ':' || o.scope || ':' || o.key as name from p join ordered o on o.action = 'add' and o.since <= p.fetched and (o.until is null or p.fetched < o.until)
  and ((o.scope = 'host' and o.key = p.host) or (o.scope = 'domain' and (o.key = p.host or p.host like '%.' || o.key))
    or (o.scope = 'prefix' and (o.key = p.host or list_contains(list_transform(range(1, len(p.path) + 1), lambda i: p.host || '/' || array_to_string(p.path[1:i], '/')), o.key))))),
g as (select page_id, count(*) as n_active, string_agg(distinct name, ',' order by name) as matches from hit group by page_id)
select p.page_id, p.host, p.fetched, coalesce(n_active, 0) > 0 as blocked, coalesce(n_active, 0) as n_active, coalesce(matches, '') as matches
from p left join g on g.page_id = p.page_id
"""
