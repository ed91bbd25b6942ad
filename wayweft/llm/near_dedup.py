"""MinHash near-dedup with circulant signatures, exact verification and connected components.

A document is the set of its distinct k-word shingles (with fewer words, of the whole sequence). Two
permutations make the signature: the first deals shingles to D slots, the second, an array over the slots,
is read at D positions shifted by 0, 1, 2, ... for the coordinates, so a shingle contributes one contiguous
slice of it. Coordinates are cut into bands; documents that share a band are candidates, and every link is
confirmed on the full sets.

Documents with the same set are one vertex. Bands are taken in groups: in each bucket a hub (the vertex that shares
most buckets with most others) is compared with the members that are not in its component yet, and what is linked is
contracted before the next group, so no pair is met again within a component. Then what is outside a bucket's largest
component is compared with a few of its members, twice. What is still outside is compared with all members of that
component, and with each other. So each pair of a bucket is compared or already connected, without emitting pairs
inside components; the last step sends sets to blocks of members and looks for one link to each component there, so
its rows grow with the outsiders, not with the pairs.

Results: one row per row of the table. A null or blank text has an empty set and is linked with nothing. Each row is
judged by its own text. A row with a null id takes part, after all ids: component_id is null where no row of the
component has one. An empty table gives no row; other columns are ignored, whatever their names. keep_one() keeps one
row of a component (of rows with the same id and text any one), and all rows without words.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, scratch, wordhash
from .components import components

SHINGLE, PERCENT = 5, 80
#: Bands and coordinates in each: at a similarity of 0.8 all bands miss with a chance of about 3e-6.
BANDS, ROWS = 42, 6
SLOT_BITS = 20
#: Bands whose buckets are compared with their hubs at once, before what is linked is contracted.
GROUPS = (2, 6, 12, 22)
#: Rounds with some members of a bucket's largest component, and about how many these are.
ROUNDS, SPOKESMEN = 2, 6
#: Members outside it that are compared pair by pair; more are compared in blocks of about so many hashes.
FEW, ITEMS = 12, 100_000
#: Shares into which the rows of a group of several blocks are dealt when blocks are numbered.
SALTS = 32


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The set as sorted 64-bit hashes."""
    words = wordhash.word_hashes((text or "").encode(), lower=True)
    if not len(words):
        return words
    return np.unique(wordhash.sequence_hashes(words, min(k, len(words))))


class Circulant:
    """The two permutations; signature() reads one slice of the second for each shingle."""

    def __init__(self, coordinates: int, seed: int = 1):
        second = np.random.default_rng(seed).permutation(1 << SLOT_BITS).astype(np.int32)
        self.coordinates = coordinates
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = (wordhash.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.full(self.coordinates, np.iinfo(np.int32).max, dtype=np.int32)
        for at in range(0, len(slots), 2048):
            np.minimum(out, self.slices[slots[at : at + 2048]].min(axis=0), out=out)
        return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for i in range(rows):
        key = wordhash.mix(key ^ parts[:, i] * np.uint64(0xA0761D6478BD642F))
    return key.view(np.int64)


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        circulant = Circulant(bands * rows)
        for batch in frames.parts(batches):
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, k)
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                keys.append(band_keys(circulant.signature(shingles), bands, rows) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["key", "n", "digest", "bands"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in frames.parts(batches):
            sets = [shingle_set(t, k).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["v", "items"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("v").alias("a"), F.col("items").alias("_a"))
    second = sets.select(F.col("v").alias("b"), F.col("items").alias("_b"))
    both = pairs.join(second, "b").join(first, "a").withColumn("_i", F.size(F.array_intersect("_a", "_b")))
    return scratch.materialise(both.where(100 * F.col("_i") >= percent * (F.size("_a") + F.size("_b") - F.col("_i"))).select("a", "b"), name)


def _spread(*columns):
    """An even number from 0 to 1 of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / (1 << 30)


def _block_links(percent: int):
    """A link, if there is any, from each query to the block's members of each other label; compared on full sets."""

    def run(key, members, queries):
        out = ([], [])
        if members.num_rows and queries.num_rows:
            column = members.column("items").combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            items = column.flatten().to_numpy()
            order = np.argsort(items, kind="stable")
            items, owner = items[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            names, labels = members.column("v").to_numpy(), members.column("label").to_numpy()
            for v, label, own in zip(queries.column("q_v").to_pylist(), queries.column("q_label").to_pylist(), queries.column("q_items").combine_chunks()):
                own = own.values.to_numpy()
                left = np.searchsorted(items, own, "left")
                met = np.searchsorted(items, own, "right") - left
                at = np.repeat(left - np.cumsum(met) + met, met) + np.arange(met.sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                hit = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (labels != label) & (names != v))
                for other in names[hit[np.unique(labels[hit], return_index=True)[1]]].tolist():
                    out[0].append(min(v, other))
                    out[1].append(max(v, other))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _in_blocks(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members and queries (home, v, n, label): the links between those of a home.

    Sets that may be linked are of one class of sizes or of neighbouring ones. Members and queries of a home and class
    are dealt to blocks of about ITEMS hashes, and each block of queries meets each block of members."""
    wide = math.log(100 / percent) * 1.01  # a little more, so that rounding does no harm
    size_class = lambda n: F.floor(F.log(n) / wide).cast("int")
    one = members.select("home", size_class(F.col("n")).alias("class"), "v", "n", "label")
    reach = F.sequence(size_class(F.col("n") * percent / 100), size_class(F.col("n") * 100 / percent))
    two = queries.select("home", F.explode(reach).alias("class"), "v", "n", "label")
    blocks = lambda x, name: x.groupBy("home", "class").agg(F.ceil(F.sum("n") / ITEMS).cast("int").alias(name))
    # what has more than one block is seldom; its rows are dealt by a salt, too, so that a home is in no single task
    many = blocks(one, "m").join(blocks(two, "q"), ["home", "class"]).where("m > 1 or q > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lambda x: x.withColumn("salt", frames.mixed(F.col("v"), SALTS)).join(many, ["home", "class", "salt"], "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("q", F.coalesce("q", F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(F.lit("block"), "v"), F.col(n)).cast("int")
    keys = ["home", "class", "block", "q_block"]
    left = dealt(one).withColumn("block", own("m")).withColumn("q_block", every("q")).join(sets, "v").select(*keys, "v", "label", "items")
    right = dealt(two).withColumn("q_block", own("q")).withColumn("block", every("m")).join(sets, "v").select(*[F.col(x).alias(f"to_{x}") for x in keys], F.col("v").alias("q_v"), F.col("label").alias("q_label"), F.col("items").alias("q_items"))
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"to_{x}" for x in keys])).applyInArrow(_block_links(percent), "a long, b long")


def _contracted(labels: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """labels(v, label) after the links found(a, b)."""
    end = lambda x: labels.select(F.col("v").alias(x), F.col("label").alias(f"l{x}"))
    small = components(found.join(end("a"), "a").join(end("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct(), name)
    moved = labels.join(small.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return scratch.materialise(moved.select("v", F.coalesce("to", "label").alias("label")), f"{name}-all")


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, name: str = "near") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; also key (frames.row_key) and head, the key of
    the row that stands for the component (null without words)."""
    docs = docs.select(frames.row_key().alias("key"), F.col("text").cast("string").alias("text"))
    base = scratch.materialise(docs.mapInArrow(_signatures(k, bands, rows), "key struct<no_id: boolean, id: bigint, text: bigint>, n long, digest binary, bands array<long>").withColumn("row", F.monotonically_increasing_id()), f"{name}-signatures")
    # a vertex is a distinct set; copies leave their task once
    classes = scratch.materialise(base.where("n > 0").groupBy("digest").agg(F.min("row").alias("v"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands")), f"{name}-classes")
    slots = classes.select("v", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = scratch.materialise(slots.join(shared, "bucket"), f"{name}-buckets")
    sizes = scratch.materialise(buckets.groupBy("v").agg(F.first("n").alias("n"), F.sum("members").alias("score")), f"{name}-sizes")
    wanted = docs.join(classes.select("v", "key").join(sizes.select("v"), "v", "left_semi"), "key").select("v", "text")
    if not base.groupBy("key").count().where("count > 1").isEmpty():
        wanted = wanted.dropDuplicates(["v"])
    sets = scratch.materialise(wanted.mapInArrow(_sets(k), "v long, items array<long>"), f"{name}-sets")
    labels = sizes.select("v", F.col("v").alias("label"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    # 1. group by group of bands: a bucket's hub, which shares most buckets with most others, and the members that are
    # not in its component yet
    at = 0
    for turn, width in enumerate(GROUPS):
        own = buckets.where(F.col("band").between(at, at + width - 1)).select("bucket", "v", "n").join(sizes.select("v", "score"), "v").join(labels, "v")
        hubs = own.groupBy("bucket").agg(F.max(F.struct("score", "v", "n", "label")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        hubs = hubs.select("bucket", F.col("hub.v").alias("p"), F.col("hub.n").alias("p_n"), F.col("hub.label").alias("p_label"))
        star = own.join(hubs, "bucket").where((F.col("label") != F.col("p_label")) & fits("n", "p_n")).select(*pair("v", "p")).distinct()
        found = _linked(star, sets, percent, f"{name}-links")
        if not found.isEmpty():
            labels = _contracted(labels, found, f"{name}-{turn}")
        at += width
        if at >= bands:
            break

    def state(turn: int) -> DataFrame:
        """The members of the buckets with several components, each with its own and the bucket's largest one."""
        own = buckets.select("bucket", "v", "n").join(labels, "v")
        groups = own.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"))
        open_ = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.sum("m").alias("all"), F.max(F.struct("m", "label")).alias("top")).where("groups > 1")
        return scratch.materialise(own.join(open_.select("bucket", F.col("top.label").alias("top"), F.col("top.m").alias("top_m"), (F.col("all") - F.col("top.m")).alias("rest")), "bucket"), f"{name}-open-{turn}")

    # 2. what is outside a bucket's largest component, and a few of its members: the same ones in all its buckets, so
    # that a pair is seldom met twice
    for turn in range(1, ROUNDS + 1):
        now = state(turn)
        chosen = now.where((F.col("label") == F.col("top")) & (_spread("v", F.lit(turn)) * F.col("top_m") < SPOKESMEN)).select("bucket", F.col("v").alias("p"), F.col("n").alias("p_n"))
        found = _linked(now.where("label <> top").join(chosen, "bucket").where(fits("n", "p_n")).select(*pair("v", "p")).distinct(), sets, percent, f"{name}-links")
        if not found.isEmpty():
            labels = _contracted(labels, found, f"{name}-spokesmen-{turn}")

    # 3. what is still outside: with all of the largest component, and with each other
    now = state(ROUNDS + 1)
    outside = now.where("label <> top")
    asked = outside.select(F.col("top").alias("home"), "v", "n", "label").distinct()
    owners = sizes.select("v", "n").join(labels, "v").select(F.col("label").alias("home"), "v", "n", "label").join(asked.select("home").distinct(), "home", "left_semi")
    to_top = _in_blocks(owners, asked, sets, percent)
    few = outside.where(F.col("rest") <= FEW).select("bucket", "v", "n", "label")
    other = few.select("bucket", F.col("v").alias("p"), F.col("n").alias("p_n"), F.col("label").alias("p_label"))
    among_few = few.join(other, "bucket").where((F.col("v") < F.col("p")) & (F.col("label") != F.col("p_label")) & fits("n", "p_n")).select(*pair("v", "p")).distinct()
    many = outside.where(F.col("rest") > FEW).select(F.col("bucket").alias("home"), "v", "n", "label")
    last = scratch.materialise(to_top.union(_in_blocks(many, many, sets, percent)), f"{name}-links").union(_linked(among_few, sets, percent, f"{name}-links"))
    if not last.isEmpty():
        labels = _contracted(labels, last, f"{name}-last")

    # a component is named by its least key
    named = labels.join(classes.select("v", "key"), "v")
    heads = named.groupBy("label").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("vertices")).where("vertices > 1").select("label", "head")
    verdict = classes.select("digest", "v", "key").join(named.join(heads, "label").select("v", "head"), "v", "left").select("digest", F.coalesce("head", "key").alias("head"))
    out = base.select("key", "n", "digest").join(verdict, "digest", "left")
    doc_id, component = F.col("key.id"), F.coalesce("head", "key")["id"]
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept"), "key", "head")


def keep_one(docs: DataFrame, name: str = "near", **options) -> DataFrame:
    """One row of docs for each component, that of the smallest id, with all its columns, and every row without words."""
    groups = near_groups(docs, name=name, **options)
    winners = groups.where("head is null or key = head").groupBy("key").agg(F.when(F.first("head").isNull(), F.lit(1)).otherwise(F.count(F.lit(1))).alias("copies"))
    return frames.one_row_each(docs, scratch.materialise(winners, f"{name}-winners"))
