"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut into chunks (white space and what follows) and chunks into the pattern's matches. The matches not
yet known are put, as byte ids, into matrices of similar length padded at the end. In each round every row finds
its leftmost pair of minimum rank, merges it and closes the gap; the two new neighbours' ranks come from a hash
table over pairs. Rows without a mergeable pair leave their matrix (compaction), which loses one column a round.
A match of more than ALONE bytes is alone in its matrix; a row alone merges all places of its minimum pair in one round, up to the
first whose merge makes a pair of lower rank: that is what merging the leftmost one by one comes to.
A pair's rank is the rank of its joined bytes, so the table holds every split of every vocabulary entry.

Ids are the ranks themselves. No text gives a special token. Results: one row per document. A null text counts
as empty; any text decodes to its own bytes; null and repeated ids and repeated texts are ordinary rows; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames
from .chunk_cache import ChunkCache
from .pair_table import NONE, PairTable

#: White space of the pattern's \\s (Python's own has four control characters more).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where the pattern always breaks: a match never goes beyond one of these chunks.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Cells of a matrix at most, unless one row alone is longer.
CELLS = 1 << 20
#: Bytes of a match from which it has a matrix of its own: rounds of a shared one are as many as its longest row merges.
ALONE = 1000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> PairTable:
    """Every split of every vocabulary entry into two entries."""
    get = ranks.get
    pairs = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
    return PairTable(*(map(list, zip(*pairs)) if pairs else ([], [], [])))


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.table = pair_table(self.ranks)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.cache = ChunkCache(self._encode_chunks)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        order = []
        for i, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                out[i] = np.array([known], dtype=np.int32)
            elif p:
                order.append(i)
            else:
                out[i] = np.zeros(0, dtype=np.int32)
        order.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(order):
            end = at + 1
            shortest = len(pieces[order[at]])
            # a bucket's rows differ by a quarter in length at most
            while end < len(order) and shortest <= ALONE and len(pieces[order[end]]) <= shortest + shortest // 4 and (end - at + 1) * len(pieces[order[end]]) <= CELLS:
                end += 1
            self._merge_bucket(order[at:end], pieces, out)
            at = end
        return out

    def _merge_bucket(self, rows: list[int], pieces: list[bytes], out: list) -> None:
        width = len(pieces[rows[-1]])
        ids = np.full((len(rows), width + 1), -1, dtype=np.int32)  # one column more, so that the last pair has a neighbour
        for n, i in enumerate(rows):
            ids[n, : len(pieces[i])] = self.byte_id[np.frombuffer(pieces[i], dtype=np.uint8)]
        rows = np.array(rows)
        rank = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width)
        while True:
            best = rank.argmin(axis=1)  # the leftmost of the smallest
            value = rank[np.arange(len(rows)), best]
            over = value == NONE
            if over.any():
                for i, row in zip(rows[over].tolist(), ids[over]):
                    out[i] = row[row >= 0].copy()
                stay = ~over
                rows, ids, rank, best, value = rows[stay], ids[stay], rank[stay], best[stay], value[stay]
                if not len(rows):
                    return
            if len(rows) == 1:
                ids, rank = self._merge_all(ids[0], rank[0], int(value[0]))
                if not rank.shape[1]:
                    out[rows[0]] = ids[0][ids[0] >= 0].copy()
                    return
                continue
            n = np.arange(len(rows))
            ids[n, best] = value
            ids = ids[np.arange(ids.shape[1]) != (best + 1)[:, None]].reshape(len(rows), -1)
            rank = rank[np.arange(rank.shape[1]) != best[:, None]].reshape(len(rows), -1)
            if not rank.shape[1]:
                for i, row in zip(rows.tolist(), ids):
                    out[i] = row[row >= 0].copy()
                return
            inner = best < rank.shape[1]
            rank[n[inner], best[inner]] = self.table.find(ids[n[inner], best[inner]], ids[n[inner], best[inner] + 1])
            inner = best > 0
            rank[n[inner], best[inner] - 1] = self.table.find(ids[n[inner], best[inner] - 1], ids[n[inner], best[inner]])

    def _merge_all(self, ids: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """One row after a round: its pairs of rank `least` merged from the left, overlapping ones once, up to the first
        whose merge makes a pair of lower rank with a neighbour."""
        at = np.flatnonzero(rank == least)
        run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])  # of overlapping places every other one
        at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
        behind = np.concatenate([[False], np.diff(at) == 2])  # the left neighbour has just been merged, too
        left = np.where(behind, least, ids[at - 1])
        left[at == 0] = -1
        lower = (self.table.find(left, np.full(len(at), least)) < least) | (self.table.find(np.full(len(at), least), ids[at + 2 - (at + 2 == len(ids))]) < least)
        if lower.any():
            at = at[: int(lower.argmax()) + 1]
        keep = np.ones(len(ids), dtype=bool)
        keep[at + 1] = False
        ids = ids.copy()
        ids[at] = least
        ids, places = ids[keep], at - np.arange(len(at))
        rank = np.delete(rank, at)
        for side in (places, places[places > 0] - 1):
            side = side[side < len(rank)]
            rank[side] = self.table.find(ids[side], ids[side + 1])
        return ids[None, :], rank[None, :]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.pattern.findall(c) for c in chunks]
        pieces = [p.encode() for parts in split for p in parts]
        distinct = list(dict.fromkeys(pieces))
        found = dict(zip(distinct, (x.astype("<u4").tobytes() for x in self.merge(distinct))))
        out, at = [], 0
        for parts in split:
            out.append(b"".join(found[p] for p in pieces[at : at + len(parts)]))
            at += len(parts)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.cache.encode([_CHUNK.findall(t) for t in texts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def shared(path: str, pattern: str) -> ByteBpe:
    """The worker process's own, kept from task to task."""
    return ByteBpe(path, pattern)


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The number and digest of each document's ids, and the digest of what they decode to."""

    def run(batches):
        bpe = shared(path, pattern)
        for batch in frames.parts(batches):
            ids = [x for at in range(0, batch.num_rows, 200) for x in bpe.encode_batch([t or "" for t in batch.column(1).slice(at, 200).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return frames.documents(docs).mapInArrow(run, _OUT)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of each document."""

    def run(batches):
        bpe = shared(path, pattern)
        for batch in frames.parts(batches):
            ids = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return frames.documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of encoded()'s rows; bytes that are not UTF-8 become U+FFFD; null ids give a null text."""

    def run(batches):
        bpe = shared(path, pattern)
        for batch in frames.parts(batches):
            texts = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
