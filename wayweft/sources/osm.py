"""OpenStreetMap XML scans: nodes, ways and relations of one file, folder or glob (compressed files too), in one pass.

Spark's text source parts files by ranges of bytes and gives the text in pieces that end with ">". A task puts the pieces
of a range together and parses the elements that lie in it whole; what comes before the first and from the last start of
an element on are fragments, which are joined over the ranges of a file and parsed afterwards, so a file of any size is
read by many tasks, and an element may reach over several ranges. Documents may follow one another in a file. Numbers
that do not parse are null. A comment that holds an element and lies across two ranges is not recognised as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions.geo import point
from ..operators.promote import numbered

_ELEMENTS = (
    "kind string, file string, start long, at long, id long, lon double, lat double, tags map<string,string>, nds array<long>, "
    "members array<struct<ref:long,role:string>>, head string, tail string, opens boolean"
)
_TYPES = {
    "kind": pa.string(), "file": pa.string(), "start": pa.int64(), "at": pa.int64(), "id": pa.int64(), "lon": pa.float64(), "lat": pa.float64(), "tags": pa.map_(pa.string(), pa.string()),
    "nds": pa.list_(pa.int64()), "members": pa.list_(pa.struct([("ref", pa.int64()), ("role", pa.string())])), "head": pa.string(), "tail": pa.string(), "opens": pa.bool_(),
}
_OPENS = re.compile(r"<(?:node|way|relation)(?=[\s/>])")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_PROLOG = re.compile(r"<\?.*?\?>|<!DOCTYPE[^>]*>|</?osm(?=[\s/>])[^>]*>", re.S)
#: Bits of a place within a file.
_PLACE = 44


@dataclass
class Scan:
    """nodes(pos, id, lon, lat, tags), ways(pos, id, nds, tags) and relations(pos, id, members, tags) that are admitted; pos
    is the order in the files, which are ordered by their paths."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def _number(text: str | None, kind):
    try:
        value = kind(text)
    except (TypeError, ValueError):
        return None
    return value if kind is float or -(1 << 63) <= value < 1 << 63 else None


class _Elements:
    """The admitted elements of some text, as rows; of repeated keys of tags the last wins."""

    def __init__(self):
        self.rows: list[dict] = []
        self.met = 0
        self.open: dict | None = None

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        get = attributes.get
        if name in ("node", "way", "relation"):
            self.open = {"kind": name, "at": self.met, "id": _number(get("id"), int), "tags": {}, "nds": [], "members": [], "any": False}
            self.met += 1
            if name == "node":
                self.open["lon"], self.open["lat"] = _number(get("lon"), float), _number(get("lat"), float)
        elif self.open is None:
            return
        elif name == "tag":
            if (key := get("k")) is not None:
                self.open["tags"][key] = get("v")
        elif name == "nd":
            self.open["nds"].append(_number(get("ref"), int))
        elif name == "member":
            self.open["any"] = True
            if get("type") == "way":
                self.open["members"].append({"ref": _number(get("ref"), int), "role": get("role") or ""})

    def _end(self, name: str) -> None:
        row = self.open
        if row is None or name != row["kind"]:
            return
        self.open = None
        if row["id"] is None or not (
            (name == "node" and row["lon"] is not None and row["lat"] is not None) or (name == "way" and row["nds"]) or (name == "relation" and row["members"] and row["tags"].get("type") == "multipolygon")
        ):
            return
        row["tags"] = list(row["tags"].items())
        self.rows.append(row)

    def parse(self, text: str) -> None:
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler = self._start, self._end
        parser.Parse(f"<x>{_PROLOG.sub('', text)}</x>", True)


def _batch(rows: list[dict], **same) -> pa.RecordBatch:
    columns = [pa.array([same[n]] * len(rows) if n in same else [r.get(n) for r in rows], t) for n, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(_TYPES))


class _Range:
    """A range of a file: its text so far is parsed up to the last start of an element."""

    def __init__(self, file: str, start: int):
        self.file, self.start = file, start
        self.head: list[str] = []
        self.rest, self.opens = "", False
        self.elements = _Elements()

    def add(self, text: str) -> pa.RecordBatch | None:
        self.rest = text = _COMMENT.sub("", self.rest + text)
        sure = text.find("<!--")  # an open comment may hold starts that are none
        starts = [m.start() for m in _OPENS.finditer(text, 0, len(text) if sure < 0 else sure)]
        if not starts:
            return None
        if not self.opens:
            self.head.append(text[: starts[0]])
            self.opens = True
        first, last = (starts[0] if len(self.head) == 1 and self.elements.met == 0 else 0), starts[-1]
        self.elements.parse(text[first:last])
        self.rest = text[last:]
        rows, self.elements.rows = self.elements.rows, []
        return _batch(rows, file=self.file, start=self.start) if rows else None

    def fragment(self) -> pa.RecordBatch:
        head, tail = ("".join(self.head), self.rest) if self.opens else (self.rest, "")
        return _batch([{"kind": "fragment", "at": self.elements.met, "head": head, "tail": tail, "opens": self.opens}], file=self.file, start=self.start)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        a = 0
        while a < len(values):
            if files[a] == files[-1] and starts[a] == starts[-1]:
                b = len(values)
            else:
                b = next(i for i in range(a, len(values)) if files[i] != files[a] or starts[i] != starts[a])
            if now is None or (now.file, now.start) != (files[a], starts[a]):
                if now is not None:
                    yield now.fragment()
                now = _Range(files[a], starts[a])
            if (out := now.add(">".join(values[a:b]) + ">")) is not None:
                yield out
            a = b
    if now is not None:
        yield now.fragment()


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.to_pylist():
            elements = _Elements()
            elements.parse(_COMMENT.sub("", one["text"]))
            if elements.rows:
                yield _batch([r | {"at": one["at"]} for r in elements.rows], file=one["file"], start=one["start"])


def scan(spark: SparkSession, path) -> Scan:
    """One pass over the bytes; its rows are written once."""
    raw = spark.read.option("lineSep", ">").text(path)
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = tables.materialise(pieces.mapInArrow(_scanned, _ELEMENTS), "osm-scan", by="kind")
    # a fragment's end belongs to the element it opens, its beginning to the one that the last opening range before it opened
    fragments = found.where("kind = 'fragment'").select("file", "start", "at", "head", "tail", "opens")
    order = Window.partitionBy("file").orderBy("start")
    numbers = fragments.withColumn("n", F.sum(F.col("opens").cast("long")).over(order))
    part = lambda n, which, text: F.struct(n.alias("n"), F.lit(which).alias("which"), F.col(text).alias("text"))
    halves = numbers.select("file", "start", "at", F.explode(F.array(part(F.col("n") - F.col("opens").cast("long"), 0, "head"), part(F.col("n"), 1, "tail"))).alias("half")).where("half.n > 0")
    whole = halves.groupBy("file", "half.n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "half.which", "half.text"))), lambda x: x["text"]), "").alias("text"), F.max(F.when(F.col("half.which") == 1, F.struct("start", "at"))).alias("opened"),
    )
    columns = [x.split(" ")[0] for x in _ELEMENTS.split(", ")]
    stitched = whole.select("file", "text", "opened.start", "opened.at").mapInArrow(_stitched, _ELEMENTS)
    rows = found.where("kind <> 'fragment'").select(columns).union(tables.materialise(stitched, "osm-stitched", by="kind").select(columns))
    if len(raw.inputFiles()) > 1:
        files = numbered(fragments.select("file").distinct(), [F.asc("file")], "nth")
        rows = rows.join(F.broadcast(files) if len(raw.inputFiles()) < 10_000 else files, "file")
    else:
        rows = rows.withColumn("nth", F.lit(0))
    rows = rows.withColumn("pos", F.col("nth") * F.lit(1 << _PLACE) + F.col("start") + F.col("at"))
    kind = lambda name, *more: rows.where(F.col("kind") == name).select("pos", "id", *more, "tags")
    return Scan(kind("node", "lon", "lat"), kind("way", "nds"), kind("relation", "members"))


def last_by_id(rows: DataFrame) -> DataFrame:
    """Of repeated ids the last in the file."""
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "pos").alias("_last")).select("_last.*")


def node_points(node_rows: DataFrame) -> DataFrame:
    """id and point, the last of repeated ids."""
    return node_rows.groupBy("id").agg(F.max_by(point("lon", "lat"), "pos").alias("pt"))
