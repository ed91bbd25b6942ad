"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Candidates are dealt to shards by their norms, the longest first, and queries to blocks; both are as large as memory
allows; a block's queries take turns, so that the bounds of a turn are few however many there are. In a shard every
dimension is a list of its vectors sorted by value, read from the top where a query's component is positive and from the
bottom where it is negative. All lists are read to the same depth, sequentially, in a few
steps; each step adds what it has newly read. A candidate's lower bound adds to what has been read the least that unread
lists can still give (the list's last value), the upper bound the most (the value read last). A query ends when no
outsider's upper bound reaches the k-th lower bound; the remaining candidates' scores are then resolved. The steps of
many queries are done at once: what a step reads of a shard is a mask, so sums are matrix products.

A pilot search of the first shard gives every query a score that its k-th result reaches at least. A query goes only to
shards whose longest vector can reach that, and its k-th lower bound starts there. Each shard gives at most k rows for a
query; the best k of those are the result.

Results: for each query its k best candidates, fewer if there are not so many. Vectors that are null, empty, or hold
a null or non-finite component (also after scaling) take no part; vectors are compared with those of the same length
alone. Ties go to the smaller id. Scores are exact for components of any size; one beyond the range of a long is given as
the end of that range, in the order of the exact scores. Rows with a null id take no part. Repeated ids are candidates of
their own, except the query's own id; a query id that occurs more than once gives one result, for its first vector in
the order of components. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, scratch

K, SCALE = 5, 256
#: Components of a shard's vectors and of a block's queries, vectors of the pilot shard, and the shares of each list read
#: in turn.
SHARD, BLOCK, PILOT, DEPTHS = 1 << 20, 1 << 20, 1024, (0.25, 0.5, 0.75)
#: Bounds that are held at once: a block's queries are searched in turns of so many queries times vectors.
BOUNDS = 1 << 21


class SortedLists:
    """A shard's vectors, dimension by dimension, in order of value."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(n)[:, None], axis=0)
        self.values = np.take_along_axis(vectors, order, axis=0)


class Reader:
    """Lower and upper bounds of each query (row) and candidate (column), as the lists are read."""

    def __init__(self, lists: SortedLists, queries: np.ndarray):
        self.lists, self.up, self.down = lists, np.maximum(queries, 0), np.minimum(queries, 0)
        n = len(lists.vectors)
        self.depth, self.entries = 0, 0
        self.read = np.zeros((len(queries), n))
        # what of the least and the most of all lists has been replaced by values that were read
        self.worst = self.up * lists.values[0], self.down * lists.values[-1]
        self.low = np.zeros_like(self.read)

    def to(self, depth: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read every list on to depth; bounds of the live queries."""
        n, lists = len(self.lists.vectors), self.lists
        new_top = (lists.rank >= n - depth) & (lists.rank < n - self.depth)
        new_bottom = (lists.rank < depth) & (lists.rank >= self.depth)
        up, down = self.up[live], self.down[live]
        self.read[live] += up @ (lists.vectors * new_top).T + down @ (lists.vectors * new_bottom).T
        self.low[live] += self.worst[0][live] @ new_top.T + self.worst[1][live] @ new_bottom.T
        self.entries += len(live) * (depth - self.depth) * lists.vectors.shape[1]
        self.depth = depth
        top, bottom = lists.rank >= n - depth, lists.rank < depth
        worst = (self.worst[0][live].sum(axis=1) + self.worst[1][live].sum(axis=1))[:, None] - self.low[live]
        best = up * lists.values[n - depth], down * lists.values[depth - 1]
        most = (best[0].sum(axis=1) + best[1].sum(axis=1))[:, None] - best[0] @ top.T - best[1] @ bottom.T
        return self.read[live] + worst, self.read[live] + most


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of each query's k best; floors: scores that the k-th result reaches at least."""
    out: list[tuple[int, int, int]] = []
    # by powers of two into the middle of the range of doubles: nothing overflows, and no digit is lost
    scale = [2.0 ** -int(np.frexp(np.abs(x).max(initial=1))[1]) for x in (vectors, queries)]
    lists = SortedLists(vectors * scale[0])
    largest = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1]
    integers = (lambda x: x.astype(np.int64)) if largest < 2.0**62 else np.frompyfunc(int, 1, 1)
    whole = integers(vectors)
    step = max(1, BOUNDS // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        some, some_ids = queries[at : at + step], query_ids[at : at + step]
        scaled = some * scale[1]
        slack = 1e-12 * (vectors.shape[1] + 4) * np.abs(scaled).sum(axis=1)  # more than sums of doubles can be off
        least = np.full(len(some), -np.inf) if floors is None else floors[at : at + step] * scale[0] * scale[1] - slack
        survivors = _survivors(lists, scaled, some_ids[:, None] == ids[None, :], least, slack, k)
        for q, (query_id, query) in enumerate(zip(some_ids, integers(some))):
            rest = np.flatnonzero(survivors[q])
            scores = whole[rest] @ query
            if len(rest) > 4 * k and whole.dtype == np.int64:  # ties with the k-th stay for the order by id
                near = scores >= -np.partition(-scores, k - 1)[k - 1]
                rest, scores = rest[near], scores[near]
            best = sorted(zip((-s for s in scores.tolist()), ids[rest].tolist()))[:k]
            out += [(int(query_id), i, -s) for s, i in best]
    return out


def _survivors(lists: SortedLists, scaled: np.ndarray, own: np.ndarray, least: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Of each query (row) the candidates that can be among its k best, once the lists have been read as far as needed."""
    n = len(lists.vectors)
    live = np.arange(len(scaled))
    survivors = ~own
    reader = Reader(lists, scaled)
    for share in DEPTHS:
        lower, upper = reader.to(max(1, int(n * share)), live)
        lower[own[live]] = -np.inf
        bar = least[live]
        if n > k:
            bar = np.maximum(bar, -np.partition(-lower, k - 1, axis=1)[:, k - 1])
        survivors[live] &= upper >= (bar - slack[live])[:, None]
        live = live[survivors[live].sum(axis=1) > 4 * k]
        if not len(live):
            break
    return survivors


_SCORE = "decimal(38,0)"
_ROWS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.string())])


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _order(score: int) -> str:
    """Text that sorts as the integers do: sign, number of digits, digits (of negative ones their complements)."""
    digits = str(abs(score))
    head = f"{len(digits):03d}{digits}"
    return "1" + head if score >= 0 else "0" + head.translate(str.maketrans("0123456789", "9876543210"))


def _search(k: int):
    def run(key, candidates, queries):
        if not candidates.num_rows or not queries.num_rows:
            return _ROWS.empty_table()
        floors = queries.column("floor").to_numpy()
        rows = search(_matrix(candidates, "v"), candidates.column("id").to_numpy(), _matrix(queries, "q_v"), queries.column("q_id").to_numpy(), k, floors)
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([_order(r[2]) for r in rows], pa.string())], schema=_ROWS)

    return run


def top_k(table: DataFrame, is_query, k: int = K, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; is_query: a condition on `id`. Components become floor(scale * x)."""
    raw = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    # whole doubles beyond 2**53 are their own floors, and a long would not hold those beyond 2**63
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = raw.where(good).withColumn("v", F.transform("v", lambda x: floor(F.lit(float(scale)) * x))).where(F.forall("v", lambda x: F.abs(x) < float("inf"))).withColumn("dims", F.size("v"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    whole = scratch.materialise(whole.withColumn("norm", norm("v")), "topk-vectors")
    queries = whole.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")).withColumn("norm", norm("v"))
    sizes = {r["dims"]: r for r in whole.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).collect()}  # a row for each length of vectors
    if not sizes:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = None
    for dims, r in sorted(sizes.items()):
        one = _top_of_length(whole.where(F.col("dims") == dims), queries.where(F.col("dims") == dims), dims, r["n"], r["q"], k)
        out = one if out is None else out.union(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", _long(F.col("score")).alias("score"))


def _long(text):
    """The integer of _order()'s text, or the end of the range of longs that it is beyond."""
    positive = F.substring(text, 1, 1) == "1"
    plain = F.when(positive, text).otherwise(F.translate(text, "0123456789", "9876543210"))
    size, digits = F.substring(plain, 2, 3).cast("int"), F.substring(plain, 5, 400)
    exact = F.when(size <= 30, F.when(positive, digits).otherwise(F.concat(F.lit("-"), digits)).cast(_SCORE))
    low, high = F.lit("-9223372036854775808").cast(_SCORE), F.lit("9223372036854775807").cast(_SCORE)
    return F.greatest(low, F.least(high, F.coalesce(exact, F.when(positive, high).otherwise(low)))).cast("long")


def _top_of_length(whole: DataFrame, queries: DataFrame, dims: int, n: int, q: int, k: int) -> DataFrame:
    """query_id, vec_id, score (as _order() gives it) of each query's k best of each shard it goes to."""
    shards, blocks = max(1, math.ceil(n * dims / SHARD)), max(1, math.ceil(q * dims / BLOCK))
    dealt = queries.withColumn("block", frames.mixed(F.col("id"), blocks))
    keys = ["shard", "block"]
    every = lambda name, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)

    def found(candidates: DataFrame, asked: DataFrame) -> DataFrame:
        left = candidates.select("id", "v", "shard", every("block", blocks))
        right = asked.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), "floor", F.col("shard").alias("q_shard"), F.col("block").alias("q_block"))
        return left.groupBy(*keys).cogroup(right.groupBy("q_shard", "q_block")).applyInArrow(_search(k), "query_id long, vec_id long, score string")

    none = F.lit(float("-inf"))
    if shards == 1:
        return found(whole.withColumn("shard", F.lit(0)), dealt.withColumn("floor", none).withColumn("shard", F.lit(0)))
    # a pilot of the longest vectors: a score that each query's k-th result reaches at least
    pilot = whole.orderBy(F.desc("norm"), "id").limit(PILOT).withColumn("shard", F.lit(0))
    first = found(pilot, dealt.withColumn("floor", none).withColumn("shard", F.lit(0)))
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), _long(F.col("score")).cast("double").alias("floor"))
    # a score at the end of the range of longs says nothing
    asked = dealt.join(floors, "id", "left").withColumn("floor", F.when(F.abs("floor") < 9e18, F.col("floor")).otherwise(none))
    # shards by norm
    ranged = scratch.materialise(whole.repartitionByRange(shards, F.desc("norm"), "id").withColumn("shard", F.spark_partition_id()), "topk-shards")
    longest = [(r["shard"], r["norm"]) for r in ranged.groupBy("shard").agg(F.max("norm").alias("norm")).orderBy("shard").collect()]  # a row for each shard
    goes = F.filter(F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(m).alias("most")) for i, m in longest]), lambda s: s["most"] * F.col("norm") * (1 + 1e-9) >= F.col("floor"))
    return found(ranged, asked.withColumn("to", F.explode(goes)).select("id", "v", "floor", "block", F.col("to.shard").alias("shard")))
