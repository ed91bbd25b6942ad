"""Conversation repair: the cheapest edits that turn a conversation's rows into (system) user assistant user assistant ...

Rows are taken by turn (nulls first; ties by role, then text; equal rows adjacent). A row's first fault counts: blank (no
character but spaces), duplicate (its role and text came before), truncated (its last such character ends no sentence).
Edits are Keep (0), Rerole to user or assistant (3), Delete (4; needed for blank and duplicate rows) and Insert of an empty
user or assistant turn (3); a truncated row that stays adds 3. Dijkstra's search runs on the implicit lattice of (rows
done, state of the grammar) with the key (cost, audit), the audit being the edits' initials, and stops at the first
accepting end it takes up, so of equally cheap repairs the one of the least audit is found.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length lies in several tasks. One
that fits is repaired where it lies. A longer one, or one at a range's edge, is cut into segments of at most SEGMENT rows:
each is searched from every state it can be entered in, to every state it can be left in; a backward pass over the
segments' costs (some hundred bytes each) chooses the states between them, the least audit first. Only the last step, one
hash over the whole repaired conversation, reads it in one task, as a stream of pieces.

Results: one row per conv_id of the table (null is one, too). Null roles and texts count as one space. A role is judged by
its first character; an empty one fits nowhere. Repeated rows are duplicates. Conversations without a row left, or whose
rows are all deleted, get an empty audit or one of deletions, and the hash of an empty string. An empty table gives no row;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, scratch

SPACES = " \t\n\v\f\r"
#: Costs of the edits; what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of a segment; rows and bytes of a task.
SEGMENT, SEGMENT_CHARS, TASK_ROWS, TASK_BYTES = 512, 1 << 20, 500_000, 64 << 20
#: States: nothing yet, after system, after user, after assistant; where a row of some initial leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an inserted or reroled turn gets in each state, and the state it leads to.
NEEDS = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Insertions that bring a state to an end of the grammar.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Row = tuple[str, str]
SOUND, CUT_OFF, UNFIT = range(3)  # unfit: blank or duplicate


def search(initials: str | list[str], kinds: list[int], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """Cost and audit of the best way from `start` over all rows. whole: to the first accepting end alone, under START;
    otherwise to every state in which the last row can leave the grammar."""
    n, found, done = len(kinds), {}, set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not whole or not TAILS[state]):
            found[START if whole else state] = cost, audit
            if whole:
                return found
        if i < n:
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if kinds[i] != UNFIT:
                stays = cost + (TRUNCATED if kinds[i] == CUT_OFF else 0)
                if (to := STEPS[state].get(initials[i])) is not None:
                    heapq.heappush(heap, (stays, audit + "K", i + 1, to))
                heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, NEEDS[state][1]))
        if whole or i < n:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEEDS[state][1]))
    return found


def apply_edits(rows: list[Row], audit: str, state: int = START) -> list[Row]:
    out, at = [], iter(rows)
    for edit in audit:
        if edit == "I":
            role, state = NEEDS[state]
            out.append((role, ""))
            continue
        role, text = next(at)
        if edit == "K":
            state = STEPS[state][role[:1]]
            out.append((role, text))
        elif edit == "R":
            role, state = NEEDS[state]
            out.append((role, text))
    return out


def _mark(row: Row) -> bytes:
    return hashlib.sha256(f"{len(row[0])}:{row[0]}{row[1]}".encode()).digest()


def faults(rows: list[Row], before: frozenset | set = frozenset()) -> tuple[list[int], list[int]]:
    """Of each row what it allows; and the numbers of blank, duplicate and truncated rows. before: marks seen earlier."""
    kinds, counts, seen = [], [0, 0, 0], set()
    for row in rows:
        text = row[1].strip(SPACES)
        if not text:
            which = 0
        elif row in seen or (before and _mark(row) in before):
            which = 1
        else:
            which = None if text[-1] in ".!?" else 2
        seen.add(row)
        if which is not None:
            counts[which] += 1
        kinds.append(SOUND if which is None else CUT_OFF if which == 2 else UNFIT)
    return kinds, counts


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _joined(rows: list[Row]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


_TURNS = "array<struct<role string, text string>>"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DEALT = f"conv_id long, part int, seg int, split boolean, turns array<long>, rows {_TURNS}, marks array<binary>, {_REPORT}, repaired {_TURNS}"
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TYPES = {
    "conv_id": pa.int64(), "part": pa.int32(), "seg": pa.int32(), "split": pa.bool_(), "turns": pa.list_(pa.int64()), "rows": _ROWS, "marks": pa.list_(pa.binary()),
    **dict.fromkeys(_NUMBERS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string(), "repaired": _ROWS, "piece": _ROWS,
    "n": pa.int32(), "initials": pa.string(), "costs": pa.list_(pa.int32()), "order": pa.list_(pa.int32()), "audits": pa.list_(pa.string()), "entry": pa.int32(), "exit": pa.int32(), "tail": pa.string(),
    "least": pa.int64(), "most": pa.int64(), "distinct": pa.int64(), "no_turn": pa.bool_(),
}


def _batches(rows: Iterator[dict], names: list[str], size: int = 500) -> Iterator[pa.RecordBatch]:
    def batch(some):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in some], _TYPES[n]) for n in names], names=names)

    some, none = [], True
    for row in rows:
        some.append(row)
        if len(some) >= size:
            yield batch(some)
            some, none = [], False
    if some or none:
        yield batch(some)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.replace(_TURNS, "rows").split(", ")]


def repair_one(turns: list[int | None], rows: list[Row]) -> dict:
    """The report and the repaired rows of one conversation that is all here."""
    kinds, (blank, duplicate, truncated) = faults(rows)
    initials = [r[:1] for r, _ in rows]
    cost, audit = search(initials, kinds, START, whole=True)[START]
    known = [t for t in turns if t is not None]
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    return {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": _illegal(initials), "cost": cost, "audit": audit, "repaired": apply_edits(rows, audit)}


def _dealt(digest: bool, segment: int):
    """Sorted rows: whole conversations are repaired, others cut into segments."""

    def run(batches):
        nothing = object()
        part, seg, conv, first, size = 0, 0, nothing, True, 0
        turns: list[int | None] = []
        rows: list[Row] = []
        cut = False  # whether the conversation has had a segment already

        def close(last: bool) -> dict:
            nonlocal seg
            if cut or first or last:
                seg += 1
                return {"conv_id": conv, "part": part, "seg": seg, "split": True, "turns": turns, "rows": [{"role": r, "text": t} for r, t in rows], "marks": list({_mark(x) for x in rows})}
            out = {"conv_id": conv, "part": part, "seg": 0, "split": False} | repair_one(turns, rows)
            if digest:
                out["repaired_sha256"] = hashlib.sha256(_joined(out.pop("repaired")).encode()).hexdigest()
            else:
                out["repaired"] = [{"role": r, "text": t} for r, t in out["repaired"]]
            return out

        for batch in batches:
            for c, p, turn, role, text, times in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "turn", "role", "text", "times"))):
                if c != conv:
                    if conv is not nothing:
                        yield close(False)
                        first = False
                    conv, part, turns, rows, cut, size = c, p, [], [], False, 0
                for _ in range(times):
                    if len(rows) >= segment or (rows and size + len(text) > SEGMENT_CHARS):
                        cut = True
                        yield close(False)
                        turns, rows, size = [], [], 0
                    turns.append(turn)
                    rows.append((role, text))
                    size += len(text)
        if conv is not nothing:
            yield close(True)

    return lambda batches: _batches(run(batches), _names(_DEALT))


_SOLVED = "conv_id long, part int, seg int, n int, blank long, duplicate long, truncated long, illegal long, initials string, least long, most long, distinct long, no_turn boolean, costs array<int>, order array<int>, audits array<string>"


def _pairs(rows: list[dict]) -> list[Row]:
    return [(r["role"], r["text"]) for r in rows]


def _solved(batches):
    """A segment from every state to every state: costs (-1: no way), and the audits' order among the ways from a state."""

    def run():
        for batch in batches:
            for one in batch.to_pylist():
                rows, known = _pairs(one["rows"]), [t for t in one["turns"] if t is not None]
                kinds, counts = faults(rows, set(one["before"] or ()))
                initials = [r[:1] for r, _ in rows]
                costs, order, audits = [-1] * 16, [0] * 16, [""] * 16
                for s in range(4):
                    ways = search(initials, kinds, s, whole=False)
                    for place, t in enumerate(sorted(ways, key=lambda t: ways[t][1])):
                        costs[4 * s + t], audits[4 * s + t], order[4 * s + t] = *ways[t], place
                yield {
                    "conv_id": one["conv_id"], "part": one["part"], "seg": one["seg"], "n": len(rows), "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": _illegal(initials),
                    "initials": "".join(x or "-" for x in (initials[:1] + initials[-1:])), "least": known[0] if known else None, "most": known[-1] if known else None, "distinct": len(set(known)), "costs": costs, "order": order, "audits": audits,
                }

    return _batches(run(), _names(_SOLVED), 100)


_CHOSEN = "conv_id long, part int, seg int, entry int, exit int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chosen(key, table):
    """The states between a conversation's segments; its counts stand with the last one."""
    parts = sorted(table.to_pylist(), key=lambda x: (x["part"], x["seg"]))
    some = [x for x in parts if x["n"]] or parts[:1]
    # the least cost from each state at each segment to the end
    togo = [[INSERT * len(TAILS[s]) for s in range(4)]]
    for one in reversed(some):
        if one["n"]:
            togo.append([min((one["costs"][4 * s + t] + togo[-1][t] for t in range(4) if one["costs"][4 * s + t] >= 0), default=1 << 60) for s in range(4)])
        else:
            togo.append(togo[-1])
    togo.reverse()
    state, out = START, []
    for one, here, beyond in zip(some, togo, togo[1:]):
        best = [t for t in range(4) if one["n"] and one["costs"][4 * state + t] >= 0 and one["costs"][4 * state + t] + beyond[t] == here[state]]
        to = min(best, key=lambda t: one["order"][4 * state + t]) if best else state
        out.append({"conv_id": one["conv_id"], "part": one["part"], "seg": one["seg"], "entry": state, "exit": to, "tail": ""})
        state = to
    known = [x for x in some if x["least"] is not None]
    distinct = sum(x["distinct"] for x in known) - sum(a["most"] == b["least"] for a, b in zip(known, known[1:]))
    out[-1] |= {name: sum(x[name] for x in some) for name in ("blank", "duplicate", "truncated", "illegal")}
    out[-1]["illegal"] += sum(a["initials"][-1] + b["initials"][0] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
    out[-1] |= {"tail": TAILS[state], "cost": togo[0][START], "gaps": known[-1]["most"] - known[0]["least"] + 1 - distinct if known else 0}
    names = _names(_CHOSEN)
    return pa.table({n: pa.array([r.get(n) for r in out], _TYPES[n]) for n in names})


_PIECES = f"conv_id long, part int, seg int, audit string, piece {_TURNS}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _pieces(batches):
    """The chosen edits of a segment, applied to its rows."""

    def run():
        for batch in batches:
            for one in batch.to_pylist():
                audit = one["audit"] + one["tail"]
                rows = apply_edits(_pairs(one["rows"]), audit, one["entry"])
                yield one | {"audit": audit, "piece": [{"role": r, "text": t} for r, t in rows]}

    return _batches(run(), _names(_PIECES), 100)


_WHOLE = f"conv_id long, {_REPORT}"


def _hashed(batches):
    """One report for each conversation, from its pieces in order."""

    def run():
        conv, audit, digest, empty, out = None, None, None, True, {}
        for batch in batches:
            for one in batch.to_pylist():
                if audit is None or one["conv_id"] != conv:
                    if audit is not None:
                        yield out | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                    conv, audit, digest, empty = one["conv_id"], [], hashlib.sha256(), True
                audit.append(one["audit"])
                if one["piece"]:
                    digest.update((("" if empty else "\n") + _joined(_pairs(one["piece"]))).encode())
                    empty = False
                if one["cost"] is not None:
                    out = {n: one[n] for n in _NUMBERS} | {"conv_id": conv}
        if audit is not None:
            yield out | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    return _batches(run(), _names(_WHOLE), 100)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with planted faults, and how many times each row stands (0: dropped), by the CRC-32 of
    conv_id:turn. Nulls count as one space."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("times"),
    )


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text as they are, nulls as one space, each once."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(1).alias("times"))


def _run(rows: DataFrame, digest: bool, segment: int, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of plain() or damaged() rows: what was repaired whole, and the pieces of the rest."""
    # equal rows, which may be very many, are counted before they are dealt
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    tasks = max(frames.partitions(rows.sparkSession), frames.blocks_for(n, task_rows), frames.blocks_for(size or 0, TASK_BYTES))
    order = ["conv_id", "turn", "role"]  # rows that agree in these and in much text are one range's
    ordered = counted.repartitionByRange(tasks, *order, F.substring("text", 1, 256)).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    dealt = scratch.materialise(ordered.mapInArrow(_dealt(digest, segment), _DEALT), "conversations")
    cut = dealt.where("split").select("conv_id", "part", "seg", "turns", "rows", "marks")
    # marks seen in an earlier segment of the conversation
    seen = cut.select("conv_id", F.struct("part", "seg").alias("at"), F.explode("marks").alias("mark"))
    seen = seen.withColumn("first", F.min("at").over(Window.partitionBy("conv_id", "mark"))).where("first < at")
    before = seen.groupBy(F.col("at.part").alias("part"), F.col("at.seg").alias("seg")).agg(F.collect_list("mark").alias("before"))
    solved = scratch.materialise(cut.drop("marks").join(before, ["part", "seg"], "left").mapInArrow(_solved, _SOLVED), "conversation-segments")
    chosen = solved.drop("audits").groupBy("conv_id").applyInArrow(_chosen, _CHOSEN).drop("conv_id")
    ways = solved.select("part", "seg", "audits").join(chosen, ["part", "seg"]).withColumn("audit", F.col("audits")[4 * F.col("entry") + F.col("exit")]).drop("audits")
    pieces = cut.select("conv_id", "part", "seg", "rows").join(ways, ["part", "seg"]).mapInArrow(_pieces, _PIECES)
    return dealt.where("not split"), pieces


def reports(rows: DataFrame, segment: int = SEGMENT, task_rows: int = TASK_ROWS) -> DataFrame:
    """Of plain() or damaged() rows, one row per conversation: conv_id, gaps (turns missing between the first and the last),
    blank, duplicate, truncated, illegal (adjacent roles), cost, audit and the SHA-256 of the repaired role:text lines."""
    whole, pieces = _run(rows, True, segment, task_rows)
    columns = _names(_WHOLE)
    hashed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_hashed, _WHOLE)
    return whole.select(columns).union(hashed.select(columns))


def repaired(rows: DataFrame, segment: int = SEGMENT, task_rows: int = TASK_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, part, seg and i (their order), role and text."""
    whole, pieces = _run(rows, False, segment, task_rows)
    columns = ["conv_id", "part", "seg"]
    turns = whole.select(*columns, F.posexplode("repaired").alias("i", "turn")).union(pieces.select(*columns, F.posexplode("piece").alias("i", "turn")))
    return turns.select(*columns, "i", "turn.role", "turn.text")
