"""Substring dedup: word windows that occur anywhere else are removed, by suffix automata and matching statistics.

Reference shards are passages of the documents, as words. A shard is a suffix automaton with occurrence counts; passages
are streamed through it, and wherever the longest match is at least a window long and its last window occurs twice or
more in the shard, that window is removed. Nothing else decides: hashes only say where passages go.

Passages are routed by anchors: the anchor of a window is the smallest hash of its groups of eight words, so equal
windows have equal anchors, and every window belongs to the passage around one place of its anchor (neighbouring windows
mostly share it). An exchange of anchors first tells each block of documents which of its anchors occur again at all.
Only those passages become reference passages; equal ones are one, with a count. While they are few (BROADCAST_WORDS,
counted first), one automaton of all of them is broadcast and the documents are streamed through it; beyond that, a
shard has all passages of some anchors, and the shards' findings go back to the blocks that sent a passage.

No key grows with a hot passage: anchors are settled in two levels, a block sends a passage once, and what many blocks
share (HOT) is sent window by window, each routed by itself, so that varied surroundings do not meet in one place.

Results: one row per row of the table. A null text has no words. Windows of one document count like others; null and
repeated ids and texts are ordinary rows. An empty table gives no row; other columns are ignored, whatever their names.
Removal is judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, scratch, wordhash

WINDOW = 35
#: Words of an anchor; bytes of text of a block, of an exchange's partition, and for each range of hashes.
ANCHOR, BLOCK_BYTES, PARTITION_BYTES, RANGE_BYTES = 8, 2 << 20, 64 << 20, 32 << 20
#: Words of the passages of one automaton; words of all passages up to which the automaton is broadcast.
SHARD_WORDS, BROADCAST_WORDS = 20_000, 100_000
#: Groups of blocks that share an anchor from which its windows are routed one by one.
HOT = 32

_U = np.uint64


class SuffixAutomaton:
    """All substrings of a set of integer sequences, with the number of places at which each ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, nexts: dict[int, int], link: int, length: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state of its own for what reaches q by c from p and is shorter than q's longest."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], times: int = 1) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state({}, 0, length[last] + 1), last
                while p != -1 and c not in nexts[p]:
                    nexts[p][c] = new
                    p = link[p]
                if p != -1:
                    q = nexts[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = new
            count[last] += times

    def settle(self) -> SuffixAutomaton:
        """Counts of the longer ones are handed to their suffixes; to be called once, after the last add()."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]
        return self

    def spans(self, sequence: list[int], window: int, times: int = 2) -> list[tuple[int, int]]:
        """Where windows of the sequence lie that occur at least so many times here, as (start, end), merged."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        state = have = 0
        out: list[list[int]] = []
        for i, c in enumerate(sequence):
            to = nexts[state].get(c)
            while to is None and state:
                state = link[state]
                have = length[state]
                to = nexts[state].get(c)
            if to is None:
                continue
            state, have = to, have + 1
            if have < window:
                continue
            while length[link[state]] >= window:
                state = link[state]
            have = min(have, length[state])
            if count[state] >= times:
                if out and i + 1 - window <= out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([i + 1 - window, i + 1])
        return [(a, b) for a, b in out]


def anchor_places(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all groups, and for each window the place of its anchor: the first group of the smallest hash in it."""
    k = min(ANCHOR, window)
    width = window - k + 1
    if len(words) < window:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    groups = wordhash.sequence_hashes(words, k)
    at, have = np.arange(len(groups)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(groups[right] < groups[left], right, left)
        have += step
    return wordhash.mix(groups), at  # anchors have small hashes; their keys are spread evenly


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchors as they occur, one for each place."""
    groups, at = anchor_places(words, window)
    return groups[at[np.concatenate([[True], at[1:] != at[:-1]])]] if len(at) else groups


def _twice(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, those with copies twice."""
    keys = np.sort(keys)
    keep = np.ones(len(keys), dtype=bool)
    keep[2:] = keys[2:] != keys[:-2]
    return keys[keep]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def _arrays(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in table.column(column).to_pylist()]


_SENT = "part int, team int, block int, keys binary"
_TEAM = "part int, team int, keys binary"
_KNOWN = "part int, team int, again binary, hot binary"
_BACK = "block int, again binary, hot binary"


def _send_anchors(window: int, ranges: int, teams: int):
    """A block's anchors by ranges of their values."""

    def run(key, table):
        block = key[0].as_py()
        keys = _twice(_join([anchors(wordhash.word_hashes(t), window) for t in _texts(table)]))
        edges = np.searchsorted(keys, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(_U))
        edges = np.concatenate([[0], edges, [len(keys)]])
        rows = [(i, keys[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        n = len(rows)
        return pa.table({"part": pa.array([i for i, _ in rows], pa.int32()), "team": pa.array([block % teams] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "keys": pa.array([k for _, k in rows], pa.binary())})

    return run


def _gather(key, table):
    """First level: what a team of blocks has in a range, copies twice."""
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "team": pa.array([key[1].as_py()], pa.int32()), "keys": pa.array([_twice(_join(_arrays(table, "keys"))).tobytes()], pa.binary())})


def _settle(hot: int):
    """Second level: the keys of a range that occur again, for each team that has them, and those that many teams have."""

    def run(key, table):
        teams, sent = table.column("team").to_pylist(), _arrays(table, "keys")
        keys, counts = np.unique(_join(sent), return_counts=True)
        shared = np.unique(_join([np.unique(x) for x in sent]), return_counts=True)[1] if sent else counts
        own = [np.unique(x) for x in sent]
        again, many = keys[counts > 1], keys[shared >= hot]
        pick = lambda some: pa.array([x[_member(x, some)].tobytes() for x in own], pa.binary())
        return pa.table({"part": pa.array([key[0].as_py()] * len(teams), pa.int32()), "team": pa.array(teams, pa.int32()), "again": pick(again), "hot": pick(many)})

    return run


def _hand_back(key, sent, known):
    """What a team knows of a range, to its blocks."""
    again, hot = _join(_arrays(known, "again")), _join(_arrays(known, "hot"))
    own = [np.unique(x) for x in _arrays(sent, "keys")]
    pick = lambda some: pa.array([x[_member(x, some)].tobytes() for x in own], pa.binary())
    return pa.table({"block": sent.column("block").cast(pa.int32()), "again": pick(again), "hot": pick(hot)})


class Candidates:
    """A block's windows whose anchors occur again, as passages of its documents."""

    def __init__(self, back: pa.Table, window: int):
        self.window = window
        self.again, self.hot = (np.sort(_join(_arrays(back, c))) for c in ("again", "hot"))

    def of(self, text: bytes, words: list[bytes]) -> Iterable[tuple[int, int, bytes]]:
        """(route, first word, words) of each passage of a text."""
        if not len(self.again):
            return
        groups, at = anchor_places(wordhash.word_hashes(text), self.window)
        if not len(at):
            return
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) + self.window - 1
        keys = groups[at[first]]
        wanted = np.flatnonzero(_member(keys, self.again))
        hot = _member(keys[wanted], self.hot)
        for a, b, key, single in zip(first[wanted].tolist(), last[wanted].tolist(), keys[wanted].view(np.int64).tolist(), hot.tolist()):
            if not single:
                yield key, a, b" ".join(words[a:b])
                continue
            for i in range(a, b - self.window + 1):
                passage = b" ".join(words[i : i + self.window])
                yield int.from_bytes(_digest(passage)[:8], "little", signed=True), i, passage


def _digest(passage: bytes) -> bytes:
    return hashlib.blake2b(passage, digest_size=16).digest()


_PASSAGES = "block int, route long, digest binary, words binary, n long"


def _passages(window: int):
    """A block's passages, equal ones once, with their number."""

    def run(key, table, back):
        found, candidates = {}, Candidates(back, window)
        if len(candidates.again):
            for text in _texts(table):
                for route, _, passage in candidates.of(text, text.split()):  # split at the six characters that part words
                    found[route, passage] = found.get((route, passage), 0) + 1
        block = key[0].as_py()
        return pa.table({
            "block": pa.array([block] * len(found), pa.int32()), "route": pa.array([r for r, _ in found], pa.int64()), "digest": pa.array([_digest(p) for _, p in found], pa.binary()),
            "words": pa.array([p for _, p in found], pa.binary()), "n": pa.array(list(found.values()), pa.int64()),
        })

    return run


def repeated(passages: list[tuple[bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """The spans of each passage (words, times it occurs) whose windows occur twice or more among all of them."""
    numbers: dict[bytes, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in p.split(b" ")] for p, _ in passages]
    automaton = SuffixAutomaton()
    for sequence, (_, times) in zip(coded, passages):
        automaton.add(sequence, times)
    automaton.settle()
    return [automaton.spans(sequence, window) for sequence in coded]


_FOUND = "digest binary, spans array<int>"


def _match(window: int, shard_words: int):
    """Automata of the passages that arrive in the order of their routes; a route's passages are all in one."""

    def settled(shard: list[tuple[int, bytes, bytes, int]]) -> pa.RecordBatch:
        spans = repeated([(p, n) for _, _, p, n in shard], window)
        hits = [(d, [x for ab in s for x in ab]) for (_, d, _, _), s in zip(shard, spans) if s]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.binary()), pa.array([s for _, s in hits], pa.list_(pa.int32()))], names=["digest", "spans"])

    def run(batches):
        shard, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("route", "digest", "words", "n"))):
                if size > shard_words and row[0] != last:
                    yield settled(shard)
                    shard, size = [], 0
                shard.append(row)
                size += row[2].count(b" ") + 1
                last = row[0]
        if shard:
            yield settled(shard)

    return run


def _remove(window: int, result):
    """The shards' findings of a block's passages, applied to its documents."""

    def run(key, table, back, found):
        spans = {d: s for d, s in zip(found.column("digest").to_pylist(), found.column("spans").to_pylist())}
        texts = _texts(table)
        words = [t.split() for t in texts]
        covered: list[list[tuple[int, int]]] = [[] for _ in texts]
        if spans:
            candidates = Candidates(back, window)
            for text, own, out in zip(texts, words, covered):
                for _, first, passage in candidates.of(text, own):
                    s = spans.get(_digest(passage), ())
                    out += [(first + a, first + b) for a, b in zip(s[::2], s[1::2])]
        return result(table.column("doc_id").to_pylist(), words, covered)

    return run


def _stream(shared, window: int, result):
    """Documents through the broadcast automaton."""

    def run(batches):
        numbers, automaton = shared.value
        for batch in frames.parts(batches):
            words = [x.split() for x in _texts(pa.table(batch))]
            covered = [automaton.spans([numbers.get(w, -1) for w in own], window) if len(own) >= window else [] for own in words]
            yield from result(batch.column(0).to_pylist(), words, covered).to_batches()

    return run


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def _digests(ids, words, covered):
    kept = [kept_words(w, s) for w, s in zip(words, covered)]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(list(map(len, words)), pa.int64()), "n_removed": pa.array([len(w) - len(k) for w, k in zip(words, kept)], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())})


def _kept_texts(ids, words, covered):
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([b" ".join(kept_words(w, s)).decode() for w, s in zip(words, covered)], pa.string())})


def _run(docs: DataFrame, window: int, result, schema: str, block_bytes: int, shard_words: int, broadcast_words: int, name: str = "substring") -> DataFrame:
    spark = docs.sparkSession
    docs = frames.documents(docs)
    _, size = frames.text_size(docs)
    ranges, n = frames.blocks_for(size, RANGE_BYTES, 64), frames.blocks_for(size, block_bytes, 64)
    blocks = docs.withColumn("block", frames.mixed(F.xxhash64("doc_id", "text"), n)).repartition(frames.blocks_for(size, PARTITION_BYTES, frames.partitions(spark)), "block")
    own = lambda: blocks.groupBy("block")
    # 1. which anchors occur again
    sent = scratch.materialise(own().applyInArrow(_send_anchors(window, ranges, math.isqrt(n)), _SENT), f"{name}-anchors")
    teams = sent.groupBy("part", "team").applyInArrow(_gather, _TEAM)
    known = teams.groupBy("part").applyInArrow(_settle(HOT), _KNOWN).select(F.col("part").alias("k_part"), F.col("team").alias("k_team"), "again", "hot")
    back = sent.groupBy("part", "team").cogroup(known.groupBy("k_part", "k_team")).applyInArrow(_hand_back, _BACK).where("octet_length(again) > 0")
    back = scratch.materialise(back, f"{name}-back")
    # 2. the passages around them, equal ones once
    passages = scratch.materialise(own().cogroup(back.select(F.col("block").alias("b_block"), "again", "hot").groupBy("b_block")).applyInArrow(_passages(window), _PASSAGES), f"{name}-passages")
    distinct = passages.groupBy("route", "digest").agg(F.first("words").alias("words"), F.sum("n").alias("n"))
    once = distinct.groupBy("route").agg(F.sum("n").alias("times")).where("times = 1").select("route")
    total = passages.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if total <= broadcast_words:  # bytes, so words are fewer
        shared = spark.sparkContext.broadcast(_automaton(distinct.select("words", "n").toArrow()))
        return docs.mapInArrow(_stream(shared, window, result), schema)
    # 3. automata of the passages with some anchors, and what they find, to the blocks
    shards = distinct.join(once, "route", "left_anti").repartition(frames.blocks_for(total, PARTITION_BYTES, frames.partitions(spark)), "route").sortWithinPartitions("route")
    found = shards.mapInArrow(_match(window, shard_words), _FOUND)
    home = passages.select("block", "digest").join(found, "digest")
    told = back.select("block", "again", "hot", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("array<int>").alias("spans"))
    news = told.union(home.select("block", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "digest", "spans")).withColumnRenamed("block", "n_block")

    def run(key, table, told):
        is_back = told.column("again").is_valid()
        return _remove(window, result)(key, table, told.filter(is_back), told.filter(pa.compute.invert(is_back)))

    return own().cogroup(news.groupBy("n_block")).applyInArrow(run, schema)


def _automaton(passages: pa.Table) -> tuple[dict[bytes, int], SuffixAutomaton]:
    numbers: dict[bytes, int] = {}
    automaton = SuffixAutomaton()
    for words, times in zip(passages.column("words").to_pylist(), passages.column("n").to_pylist()):
        automaton.add([numbers.setdefault(w, len(numbers)) for w in words.split(b" ")], times)
    return numbers, automaton.settle()


def removals(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space)."""
    return _run(docs, window, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string", block_bytes, shard_words, broadcast_words)


def deduplicated(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id and text, the kept words joined by one space."""
    return _run(docs, window, _kept_texts, "doc_id long, text string", block_bytes, shard_words, broadcast_words)
