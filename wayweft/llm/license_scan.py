"""License scans by canonical digest lookup, in SQL functions alone.

A text is put into canonical form (lower case, no copyright lines, one spelling of equivalent words, no
punctuation, single spaces), hashed, and joined with the digests of the known licences. The known table is fixed
in license_texts, some tens of rows of texts or of digests, so it is broadcast. Each line of a text is looked up among the known one-line
notices in the same way; their digests are constants of the plan.

Results: one row per row of the table. A null text counts as empty; an empty canonical text has a digest but is no
licence. Null and repeated ids and repeated texts are ordinary rows; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .license_texts import DIGESTS, EQUIVALENT, LICENSES, NOTICES

#: A line that opens with a copyright mark and a year, a holder or a second mark.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9<\[{:]|by )[^\n]*"
RESERVED_LINE = r"(^|\n)[ \t*#/;-]*all rights reserved[ \t.]*"
#: ASCII characters other than digits, letters and the line feed, and typographic quotes and dashes.
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F©‐-―‘-‟]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds."""
    out = F.regexp_replace(F.lower(text), "\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "\n"), RESERVED_LINE, "\n")
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.regexp_replace(out, PUNCTUATION, " ")


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_texts() -> list[tuple[str, str]]:
    out = [(name, text) for name, (title, body) in LICENSES.items() for text in (body, f"{title}\n\n{body}")]
    return out + [(name, text) for name, texts in NOTICES.items() for text in texts]


def known(spark: SparkSession) -> DataFrame:
    """license and digest of every known text."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("known")) for name, text in known_texts()])
    digests = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(x).alias("text_digest")) for name, x in DIGESTS.items()])
    one = spark.range(1)
    return one.select(F.inline(rows)).select("license", digest(one_line(canonical_lines(F.col("known")))).alias("text_digest")).union(one.select(F.inline(digests)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, license (of the whole text, or null), notices (comma-joined) and n_lines."""
    lines = frames.documents(docs).select("doc_id", canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    table = F.create_map(*[x for name, texts in NOTICES.items() for text in texts for x in (digest(one_line(canonical_lines(F.lit(text)))), F.lit(name))])
    split = F.split("lines", "\n")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(split, lambda x: F.try_element_at(table, digest(F.trim(x)))), lambda x: x.isNotNull())))
    found = lines.select("doc_id", digest(one_line(F.col("lines"))).alias("text_digest"), F.array_join(names, ",").alias("notices"), F.size(split).cast("long").alias("n_lines"))
    return found.join(F.broadcast(known(docs.sparkSession)), "text_digest", "left").select("doc_id", "text_digest", "license", "notices", "n_lines")


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def canonical(text: str) -> str:
        out = f"regexp_replace(lower({text}), '\\r\\n?', chr(10), 'g')"
        for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
            out = f"regexp_replace({out}, {quoted(pattern)}, chr(10), 'g')"
        for one, other in EQUIVALENT:
            out = f"replace({out}, {quoted(one)}, {quoted(other)})"
        return f"regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g')"

    line = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    values = lambda rows: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)
    notices = [(name, text) for name, texts in NOTICES.items() for text in texts]
    return f"""
with known as (select name, sha256({line(canonical('body'))}) as digest from (values {values(known_texts())}) v(name, body)
  union all select * from (values {values(DIGESTS.items())}) v(name, digest)),
notice as (select name, sha256({line(canonical('body'))}) as digest from (values {values(notices)}) v(name, body)),
d as (select row_number() over () as r, doc_id, {canonical("coalesce(text, '')")} as lines from {table}),
l as (select distinct r, name from (select r, unnest(string_split(lines, chr(10))) as line from d) x join notice on digest = sha256(trim(line))),
n as (select r, string_agg(name, ',' order by name) as notices from l group by r),
w as (select r, doc_id, sha256({line('lines')}) as text_digest, len(string_split(lines, chr(10)))::bigint as n_lines from d)
select w.doc_id, text_digest, known.name as license, coalesce(notices, '') as notices, n_lines
from w left join known on digest = text_digest left join n on n.r = w.r
"""
