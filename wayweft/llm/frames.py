"""Small helpers that the operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python function takes up at once. Spark bounds the bytes of what it sends
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), so a batch of long texts stays small, too.
BATCH_ROWS = 1000


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


class Kept:
    """What a worker process makes once and keeps from task to task, as long as its tasks have this as a broadcast: the
    first task of another stage lets all of it go. What is made must hold no way back to this."""

    def __init__(self, make: Callable, *args):
        self.make, self.args, self.made = make, args, None

    def get(self):
        if self.made is None:
            self.made = self.make(*self.args)
        return self.made


def kept(spark: SparkSession, make: Callable, *args) -> Broadcast:
    return spark.sparkContext.broadcast(Kept(make, *args))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as long and text alone, of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and characters of all texts, for choosing numbers of blocks."""
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return n, chars or 0


def blocks_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def mixed(column: Column, n: int) -> Column:
    """An even spread of a key over 0 .. n-1."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """A row by its id and text: rows of one key are copies of each other but for other columns. Null ids come last."""
    doc_id = F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.xxhash64(doc_id, F.col(text) if isinstance(text, str) else text).alias("text"))


def one_row_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each of keys(key, copies): key is a row_key() of docs, once, and
    copies the number of rows that have it."""
    plain = [f"c{i}" for i in range(len(docs.columns))]  # names of docs that clash with no other
    at = {c: p for c, p in zip(docs.columns, plain)}
    named = docs.toDF(*plain).withColumn("key", row_key(F.col(at["doc_id"]).cast("long"), F.col(at["text"]).cast("string")))
    met = named.join(keys.select("key", "copies"), "key")
    out = met.where("copies = 1").select(plain)
    if not keys.where("copies > 1").isEmpty():
        out = out.union(met.where("copies > 1").dropDuplicates(["key"]).select(plain))
    return out.toDF(*docs.columns)
