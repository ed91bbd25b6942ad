"""Exact dedup by Patricia-trie owners.

Every task first inserts its own rows' byte strings into compressed radix tries (a subtree for each
length), so that a hot text leaves a task once however often it occurs there. What is left
goes by length and content hash to owners, which insert the full byte strings into tries of their own;
a terminal node stores the chosen identifier and the number of rows. A task's local group is then
joined with its owner's verdict by the local group's number, so no row of a hot text meets the others.

Results: one row per row of the table. A null text counts as empty; empty texts are equal to each other. Exactly one
row of a text is kept, that of the chosen id; of several with that id, any one. A null id is chosen only where no row
of the text has an id. An empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, scratch

#: Bytes of edge labels that a task holds before it spills (owners) or hands on (first pass).
TRIE_BYTES = 48 << 20


class _Node:
    __slots__ = ("label", "children", "value", "spill")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] | None = None
        self.value: list | None = None
        self.spill = None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 16:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while a[low] == b[low]:
        low += 1
    return low


class PatriciaTrie:
    """A compressed radix trie from byte strings to values; subtrees go to files when it grows past a size.

    merge(old, new) changes the stored value in place. A spilled subtree's strings are appended to its
    file and merged when items() comes to it, in a trie of that subtree alone (which may spill again,
    deeper), so memory stays near the limit for any number of strings.
    """

    def __init__(self, merge, limit: int = TRIE_BYTES, depth: int = 0):
        self.merge, self.limit, self.depth = merge, limit, depth
        self.root, self.size, self.files = _Node(b""), 0, []

    def insert(self, key: bytes, value: list) -> list | None:
        """The stored value; None if the string went to a file."""
        node, at = self.root, self.depth
        while True:
            if node.spill is not None:
                pickle.dump((key, value), node.spill, protocol=5)
                return None
            if at == len(key):
                if node.value is None:
                    node.value = value
                else:
                    self.merge(node.value, value)
                return node.value
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = _Node(key[at:])
                child.value = value
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = child
                self.size += len(key) - at + 200
                if self.size > self.limit:
                    self._spill()
                return value
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _common(label, key[at : at + len(label)])
            middle = _Node(label[:shared])
            child.label = label[shared:]
            middle.children = {child.label[0]: child}
            node.children[key[at]] = middle
            self.size += 200
            node, at = middle, at + shared

    def _weight(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            one = stack.pop()
            total += len(one.label) + 200
            stack.extend((one.children or {}).values())
        return total

    @staticmethod
    def _hollows(node: _Node) -> list:
        found, stack = [], [node]
        while stack:
            one = stack.pop()
            if one.spill is not None:
                found.append(one.spill)
            stack.extend((one.children or {}).values())
        return found

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """Keys and values of what is in memory."""
        return self._walk(self.root, b"")

    def _walk(self, node: _Node, key: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, key)]
        while stack:
            one, key = stack.pop()
            if one.value is not None:
                yield key, one.value
            stack.extend((x, key + x.label) for x in (one.children or {}).values())

    def _spill(self) -> None:
        """The heaviest subtrees below the root's only path go to files, until half the limit is free."""
        node, key = self.root, b""
        while node.value is None and node.children and len(node.children) == 1:
            node = next(iter(node.children.values()))
            key += node.label
        weights = sorted(((self._weight(x), b) for b, x in (node.children or {}).items() if x.spill is None), reverse=True)
        for weight, first in weights:
            if self.size <= self.limit // 2:
                break
            child = node.children[first]
            spill = tempfile.TemporaryFile()
            # the strings' heads above this trie's depth are not in its labels; the files hold what this trie knows
            for k, v in self._walk(child, key + child.label):
                pickle.dump((b"\0" * self.depth + k, v), spill, protocol=5)
            for old in self._hollows(child):  # what went to files from further down moves along
                self.files = [x for x in self.files if x[1] is not old]
                old.seek(0)
                shutil.copyfileobj(old, spill)
                old.close()
            hollow = _Node(child.label[:1])
            hollow.spill = spill
            node.children[first] = hollow
            self.files.append((len(key) + 1 + self.depth, spill))
            self.size -= weight - 201

    def items(self) -> Iterator[list]:
        """The stored values; the trie is spent afterwards."""
        for _, value in self.walk():
            yield value
        self.root = _Node(b"")
        for depth, spill in self.files:
            spill.seek(0)
            below = PatriciaTrie(self.merge, self.limit, depth)
            try:
                while True:
                    below.insert(*pickle.load(spill))
            except EOFError:
                spill.close()
            yield from below.items()


def _key(data: bytes) -> bytes:
    """The length, then the bytes: equal keys are equal texts, and a length's texts share a subtree."""
    return len(data).to_bytes(8, "big") + data


def _rank(keep: str):
    """The order in which rows are chosen: by id, null ids last; then by their numbers."""
    if keep == "largest":
        return lambda doc_id, row: (doc_id is None, -(doc_id or 0), row)
    return lambda doc_id, row: (doc_id is None, doc_id or 0, row)


def _merge(old: list, new: list) -> None:
    """Values are [rank, rows, local groups]."""
    old[0] = min(old[0], new[0])
    old[1] += new[1]
    old[2] += new[2]


#: A link row has doc_id, text_key, row, local_id and sha; a group row local_id, n_bytes, hash, body, the winner's id and row, and n.
_LOCAL = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("row", pa.int64()), ("local_id", pa.int64()), ("sha", pa.string()), ("n_bytes", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("winner", pa.int64()), ("winner_row", pa.int64()), ("n", pa.int64())])
_OWNED = pa.schema([("local_id", pa.int64()), ("winner", pa.int64()), ("winner_row", pa.int64()), ("total", pa.int64())])


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _chosen(rank: tuple, keep: str) -> tuple[int | None, int]:
    """The id and the row of a rank."""
    none, number, row = rank
    return None if none else -number if keep == "largest" else number, row


def _local_groups(keep: str, limit: int):
    """First pass: a link row for each row, a group row for each distinct text of the task. A local group goes by the
    number of its first row."""

    def run(batches):
        from pyspark import TaskContext

        row, rank = TaskContext.get().partitionId() << 40, _rank(keep)
        trie = PatriciaTrie(_merge, 1 << 62)

        def groups(trie):
            out: list[list] = [[] for _ in _LOCAL.names]
            for key, v in trie.walk():
                data = key[8:]
                for column, x in zip(out, (None, None, None, v[2][0], None, len(data), xxhash.xxh3_64_intdigest(data) - (1 << 63), data, *_chosen(v[0], keep), v[1])):
                    column.append(x)
                if len(out[0]) >= 500:
                    yield _batch(_LOCAL, out)
                    out = [[] for _ in _LOCAL.names]
            if out[0]:
                yield _batch(_LOCAL, out)

        for batch in frames.parts(batches):
            ids, rows, locals_, shas = batch.column(0).to_pylist(), [], [], []
            for doc_id, data in zip(ids, batch.column(1).cast(pa.binary()).to_pylist()):
                data = data or b""
                value = trie.insert(_key(data), [rank(doc_id, row), 1, []])
                if not value[2]:
                    value[2] = [row, hashlib.sha256(data).hexdigest()]
                rows.append(row)
                locals_.append(value[2][0])
                shas.append(value[2][1])
                row += 1
            none = [None] * len(ids)
            yield _batch(_LOCAL, [ids, batch.column(2).to_pylist(), rows, locals_, shas, none, none, none, none, none, none])
            if trie.size > limit:
                yield from groups(trie)
                trie = PatriciaTrie(_merge, 1 << 62)
        yield from groups(trie)

    return run


def _owners(keep: str, limit: int):
    """Second pass: each local group with the winner and the number of rows of its text."""

    def run(batches):
        trie, rank = PatriciaTrie(_merge, limit), _rank(keep)
        for batch in batches:
            for local_id, body, winner, winner_row, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                trie.insert(_key(body), [rank(winner, winner_row), n, [local_id]])
        out: list[list] = [[] for _ in _OWNED.names]
        for best, n, members in trie.items():
            for m in members:
                for column, x in zip(out, (m, *_chosen(best, keep), n)):
                    column.append(x)
            if len(out[0]) >= 5000:
                yield _batch(_OWNED, out)
                out = [[] for _ in _OWNED.names]
        yield _batch(_OWNED, out)

    return run


def exact_groups(docs: DataFrame, keep: str = "largest", limit: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs, and its key (frames.row_key); keep: the
    largest or smallest id stays."""
    spark = docs.sparkSession
    schema = "doc_id long, text_key long, row long, local_id long, sha string, n_bytes long, hash long, body binary, winner long, winner_row long, n long"
    keyed = frames.documents(docs, frames.row_key()["text"].alias("text_key"))
    local = scratch.materialise(keyed.mapInArrow(_local_groups(keep, limit), schema), "exact-local")
    groups = local.where("body is not null").repartition(frames.partitions(spark), "n_bytes", "hash")
    owned = groups.select("local_id", "body", "winner", "winner_row", "n").mapInArrow(_owners(keep, limit), "local_id long, winner long, winner_row long, total long")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    return (
        local.where("row is not null")
        .select("doc_id", "text_key", "row", "local_id", "sha")
        .join(owned, "local_id")
        .select("doc_id", F.col("winner").alias("keep_id"), F.col("total").alias("group_size"), (F.col("row") == F.col("winner_row")).alias("kept"), F.col("sha").alias("text_sha256"), key.alias("key"))
    )


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row of docs for each text, that of the chosen id, with all its columns."""
    alike = exact_groups(docs, keep).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    winners = alike.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max("kept").alias("kept")).where("kept")
    return frames.one_row_each(docs, scratch.materialise(winners.select("key", "copies"), "exact-winners"))
