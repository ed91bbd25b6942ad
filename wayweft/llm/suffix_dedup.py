"""Suffix-array dedup: byte windows that start anywhere else, too, are removed, by logarithmic families of suffix arrays.

Every window is routed by its anchor, the group of bytes with the smallest hash in it: equal windows have equal anchors.
An exchange first tells each block of documents which of its anchors occur again; the passages around those (the windows
of one anchor, some 600 bytes) go to shards by anchor. In a shard a family of suffix arrays (suffix_index) takes them up
batch by batch, and its merge-scans decide what recurs; hashes only route. The findings go back to the blocks.

No route grows with a hot passage: an anchor around which many different passages lie (HOT) is parted by the place of the
anchor in the window and by what all windows of a run of such places share; where that is still common, by shorter runs,
down to single windows, whose routes are their own contents.

Results: one row per row of the table. A null text is empty; matches never cross texts, and texts shorter than a window
lose nothing. Null and repeated ids and texts are ordinary rows. An empty table gives no row; other columns are ignored,
whatever their names. Windows are judged on the input, not on what is left; what is left may part a character, so it is
binary.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, scratch, wordhash
from .substring_dedup import _BACK, _KNOWN, _SENT, _TEAM, _arrays, _gather, _hand_back, _join, _member, _settle, _texts, _twice
from .suffix_index import BATCH, Family, words

WINDOW = 400
#: Bytes of a group whose hash makes an anchor, and of the key at an anchor; windows have at least KEY bytes.
GROUP, KEY = 16, 32
#: Bytes of text of a block, of an exchange's partition, and for each range of hashes; of a shard's passages.
BLOCK_BYTES, PARTITION_BYTES, RANGE_BYTES, SHARD_BYTES = 2 << 20, 64 << 20, 32 << 20, 4 << 20
#: Different passages of a route from which it is parted.
HOT = 4096
#: Windows looked at at once.
STEP = 1 << 18

_U = np.uint64
_ONE, _TWO = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


class Block:
    """Texts one after another in one buffer."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.stops = np.cumsum(self.sizes)
        self.bytes = b"".join([*texts, bytes(KEY)])
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.total = len(self.data) - KEY

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: their first and last starts, the anchor's place and its key."""
        if window < KEY:
            raise ValueError(f"windows have at least {KEY} bytes")
        wide = window - KEY + 1
        word = words(self.data)
        first, last, anchor = [], [], []
        for a in range(0, self.total - window + 1, STEP):
            b = min(self.total - window + 1, a + STEP)  # windows that start in a .. b-1
            n = b - a + wide - 1
            groups = word[a : a + n].astype(_U) * _ONE + word[a + 8 : a + 8 + n].astype(_U) * _TWO
            groups = ((groups ^ (groups >> _U(29))) & _U(0xFFFFFFFF)) << _U(32) | np.arange(n, dtype=_U)
            at = a + (_minima(groups, wide) & _U(0xFFFFFFFF)).astype(np.int64)
            text = np.searchsorted(self.stops, np.array([a, b - 1]), side="right")
            inside = np.ones(b - a, dtype=bool)  # windows across two texts do not count
            for stop in self.stops[text[0] : text[1] + 1].tolist():
                inside[max(0, stop - window + 1 - a) : max(0, stop - a)] = False
            whole = np.flatnonzero(inside)
            if not len(whole):
                continue
            at = at[whole]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)]))
            first.append(a + whole[new])
            last.append(a + whole[np.append(new[1:], len(whole)) - 1])
            anchor.append(at[new])
        first, last, anchor = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last, anchor))
        # a run that two steps share is one: where steps end depends on the order of a block's rows, a run must not
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1))[: len(first)])
        first, last, anchor = first[new], last[np.append(new[1:], len(last))[: len(new)] - 1], anchor[new]
        keys = np.zeros(len(anchor), _U)
        for i in range(0, KEY, 8):
            keys = wordhash.mix(keys ^ word[anchor + i].astype(_U) * _ONE)
        return first, last, anchor, keys


def _minima(values: np.ndarray, wide: int) -> np.ndarray:
    """The smallest of each run of `wide` consecutive values, by the running minima of blocks from both ends."""
    n = len(values) - wide + 1
    padded = np.full(-(-len(values) // wide) * wide, np.iinfo(np.uint64).max, _U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, wide)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[wide - 1 : wide - 1 + n])


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _send_anchors(window: int, ranges: int, teams: int):
    """A block's anchors by ranges of their values."""

    def run(key, table):
        block = key[0].as_py()
        keys = _twice(Block(_texts(table)).runs(window)[3])
        edges = np.searchsorted(keys, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(_U))
        edges = np.concatenate([[0], edges, [len(keys)]])
        rows = [(i, keys[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        n = len(rows)
        return pa.table({"part": pa.array([i for i, _ in rows], pa.int32()), "team": pa.array([block % teams] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "keys": pa.array([k for _, k in rows], pa.binary())})

    return run


def _candidates(block: Block, window: int, again: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(route, start, anchor in it, bytes) of each passage around an anchor that occurs again."""
    if not len(again):
        return
    first, last, anchor, keys = block.runs(window)
    wanted = np.flatnonzero(_member(keys, again))
    for a, b, at, key in zip(first[wanted].tolist(), (last[wanted] + window).tolist(), anchor[wanted].tolist(), keys[wanted].view(np.int64).tolist()):
        yield key, a, at - a, block.bytes[a:b]


#: home: the digest of the block's passage that this one is in, from `shift` on; n: its number there.
_PASSAGES = "block int, home binary, shift int, route long, anchor int, passage binary, n long"
_PASSAGE_TYPES = (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())


def _columns(rows: list, types) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]


def _passages(window: int):
    """A block's passages, equal ones once, with their number."""

    def run(key, table, back):
        found: dict[bytes, list] = {}
        again = np.sort(_join(_arrays(back, "again")))
        if len(again):
            for route, _, at, passage in _candidates(Block(_texts(table)), window, again):
                digest = _digest(passage)
                if digest in found:
                    found[digest][-1] += 1
                else:
                    found[digest] = [key[0].as_py(), digest, 0, route, at, passage, 1]
        names = [x.split()[0] for x in _PASSAGES.split(", ")]
        return pa.table(_columns(list(found.values()), _PASSAGE_TYPES), names=names)

    return run


def parts(passage: bytes, anchor: int, route: int, window: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, route, anchor, bytes): runs of windows that have the anchor at places of one stretch of `width`; the route is
    what all windows of the stretch share, so equal windows keep equal routes."""
    for k in range(max(0, anchor - (len(passage) - window)) // width, anchor // width + 1):
        low, high = max(0, anchor - (k + 1) * width + 1), min(len(passage) - window, anchor - k * width)
        if low <= high:
            core = passage[anchor - k * width : anchor - (k + 1) * width + 1 + window]
            yield low, int.from_bytes(_digest(route.to_bytes(8, "little", signed=True), k.to_bytes(4, "little"), core)[:8], "little", signed=True), anchor - low, passage[low : high + window]


def _parted(window: int, width: int):
    names = [x.split()[0] for x in _PASSAGES.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for block, home, shift, route, anchor, passage, n in zip(*(batch.column(c).to_pylist() for c in names)):
                rows += [(block, home, shift + low, to, at, some, n) for low, to, at, some in parts(passage, anchor, route, window, width)]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays(_columns(rows, _PASSAGE_TYPES), names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays(_columns(rows, _PASSAGE_TYPES), names=names)

    return run


_FOUND = "block int, home binary, spans array<int>"


def recurring(passages: list[tuple[bytes, int]], window: int, batch: int = BATCH) -> list[list[tuple[int, int]]]:
    """What of each passage (bytes, times it occurs) is covered by windows that occur twice or more among all of them."""
    family, some, size = Family(window), [], 0
    for one in [*passages, None]:
        if one is None or size + len(one[0]) > batch:
            if some:
                family.add([p for p, _ in some], [n > 1 for _, n in some])
            some, size = [], 0
        if one is not None:
            some.append(one)
            size += len(one[0])
    out: list[list[tuple[int, int]]] = [[] for _ in passages]
    for i, a, b in family.spans():
        out[i].append((a, b))
    return out


def _match(window: int, shard_bytes: int, batch_bytes: int):
    """Families over the passages that arrive in the order of their routes; a route's passages are all in one."""

    def settled(shard: list[tuple[bytes, list]]) -> pa.RecordBatch:
        rows = []
        for spans, (_, homes) in zip(recurring([(p, sum(h[3] for h in homes)) for p, homes in shard], window, batch_bytes), shard):
            for block, home, shift, _ in homes if spans else ():
                rows.append((block, home, [shift + x for ab in spans for x in ab]))
        return pa.RecordBatch.from_arrays(_columns(rows, (pa.int32(), pa.binary(), pa.list_(pa.int32()))), names=["block", "home", "spans"])

    def run(batches):
        shard: list[tuple[bytes, list]] = []
        size, last = 0, None
        for batch in batches:
            for block, home, shift, route, passage, n in zip(*(batch.column(c).to_pylist() for c in ("block", "home", "shift", "route", "passage", "n"))):
                if size > shard_bytes and route != last:
                    yield settled(shard)
                    shard, size = [], 0
                if shard and route == last and shard[-1][0] == passage:
                    shard[-1][1].append((block, home, shift, n))
                else:
                    shard.append((passage, [(block, home, shift, n)]))
                    size += len(passage)
                last = route
        if shard:
            yield settled(shard)

    return run


def _remove(window: int, result):
    """The shards' findings of a block's passages, applied to its documents."""

    def run(key, table, told):
        known = told.column("again").is_valid()
        back, found = told.filter(known), told.filter(pa.compute.invert(known))
        spans: dict[bytes, list[int]] = {}
        for home, some in zip(found.column("home").to_pylist(), found.column("spans").to_pylist()):
            spans.setdefault(home, []).extend(some)
        block = Block(_texts(table))
        edges = np.zeros(block.total + 1, np.int32)
        if spans:
            starts, ends = [], []
            for _, a, _, passage in _candidates(block, window, np.sort(_join(_arrays(back, "again")))):
                some = spans.get(_digest(passage), ())
                starts += [a + x for x in some[::2]]
                ends += [a + x for x in some[1::2]]
            np.add.at(edges, np.array(starts, np.int64), 1)
            np.add.at(edges, np.array(ends, np.int64), -1)
        return result(table.column("doc_id").to_pylist(), block, np.cumsum(edges[:-1]) == 0)

    return run


def _kept(block: Block, keep: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Bytes, removed bytes, removed runs and what is left of each text."""
    for size, stop in zip(block.sizes.tolist(), block.stops.tolist()):
        own = keep[stop - size : stop]
        removed = size - int(np.count_nonzero(own))
        if not removed:
            yield size, 0, 0, block.bytes[stop - size : stop]
            continue
        runs = int(np.count_nonzero(own[:-1] & ~own[1:])) + (not own[0])
        yield size, removed, runs, block.data[stop - size : stop][own].tobytes()


def _digests(ids, block, keep):
    n, gone, runs, kept = zip(*_kept(block, keep)) if ids else ((),) * 4
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})


def _kept_bytes(ids, block, keep):
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "kept": pa.array([k for *_, k in _kept(block, keep)], pa.binary())})


def _unhot(passages: DataFrame, window: int, hot: int) -> DataFrame:
    """Passages whose routes have at most `hot` different ones, or single windows."""
    done = None
    for k in (8, 64, 1 << 30):
        width = max(1, (window - KEY + 1) // k)
        many = passages.groupBy("route").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot).select("route")
        different = passages.join(many, "route", "left_semi").select("route", F.xxhash64("passage").alias("p")).distinct()
        routes = scratch.materialise(different.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("route"), "suffix-hot")
        if routes.isEmpty():
            break
        cold = passages.join(routes, "route", "left_anti").select(passages.columns)
        done = cold if done is None else done.union(cold)
        passages = scratch.materialise(passages.join(routes, "route", "left_semi").select(passages.columns).mapInArrow(_parted(window, width), _PASSAGES), "suffix-parts")
    return passages if done is None else done.union(passages)


def _run(docs: DataFrame, window: int, result, schema: str, block_bytes: int, shard_bytes: int, batch_bytes: int, hot: int) -> DataFrame:
    spark = docs.sparkSession
    docs = frames.documents(docs)
    _, size = frames.text_size(docs)
    ranges, n = frames.blocks_for(size, RANGE_BYTES, 64), frames.blocks_for(size, block_bytes, 64)
    blocks = docs.withColumn("block", frames.mixed(F.xxhash64("doc_id", "text"), n)).repartition(frames.blocks_for(size, PARTITION_BYTES, frames.partitions(spark)), "block")
    own = lambda: blocks.groupBy("block")
    # 1. which anchors occur again
    sent = scratch.materialise(own().applyInArrow(_send_anchors(window, ranges, math.isqrt(n)), _SENT), "suffix-anchors")
    teams = sent.groupBy("part", "team").applyInArrow(_gather, _TEAM)
    known = teams.groupBy("part").applyInArrow(_settle(1 << 40), _KNOWN).select(F.col("part").alias("k_part"), F.col("team").alias("k_team"), "again", "hot")
    back = scratch.materialise(sent.groupBy("part", "team").cogroup(known.groupBy("k_part", "k_team")).applyInArrow(_hand_back, _BACK).where("octet_length(again) > 0").select(F.col("block").alias("b_block"), "again"), "suffix-back")
    # 2. the passages around them, and what recurs in the shards' families
    passages = scratch.materialise(own().cogroup(back.groupBy("b_block")).applyInArrow(_passages(window), _PASSAGES), "suffix-passages")
    routed = _unhot(passages, window, hot)
    total = passages.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    shards = routed.drop("anchor").repartition(frames.blocks_for(total, PARTITION_BYTES, frames.partitions(spark)), "route").sortWithinPartitions("route", "passage")
    found = shards.mapInArrow(_match(window, shard_bytes, batch_bytes), _FOUND)
    # 3. the findings, to the blocks
    none = lambda kind: F.lit(None).cast(kind)
    told = back.select("b_block", "again", none("binary").alias("home"), none("array<int>").alias("spans")).union(found.select("block", none("binary"), "home", "spans"))
    return own().cogroup(told.groupBy("b_block")).applyInArrow(_remove(window, result), schema)


def removals(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, batch_bytes: int = BATCH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs) and kept_sha256 (of the bytes that are left)."""
    return _run(docs, window, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes, shard_bytes, batch_bytes, hot)


def deduplicated(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, batch_bytes: int = BATCH, hot: int = HOT) -> DataFrame:
    """doc_id and the bytes that are left."""
    return _run(docs, window, _kept_bytes, "doc_id long, kept binary", block_bytes, shard_bytes, batch_bytes, hot)
