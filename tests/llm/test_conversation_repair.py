import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

from wayweft.llm import conversation_repair as R

sys.setrecursionlimit(10_000)
TO = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def brute(rows):
    """A conversation's report by the cheapest suffix of every row and role before it, with the edits written out."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    kinds, seen = [], set()
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, last, inserted):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        need = "a" if last == "u" else "u"
        add = lambda cost, edit, turn, rest: ways.append((cost + rest[0], edit + rest[1], turn + rest[2]))
        if inserted < 3:
            add(3, "I", ((NAMES[need], ""),), best(i, need, inserted + 1))
        if i < len(rows):
            _, _, role, text = rows[i]
            add(4, "D", (), best(i + 1, last, 0))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 3 if kinds[i] == "truncated" else 0
                if to := TO.get((last, role[:1])):
                    add(extra, "K", ((role, text),), best(i + 1, to, 0))
                add(3 + extra, "R", ((NAMES[need], text),), best(i + 1, need, 0))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, turns = best(0, "", 0)
    known = [r[1] for r in rows if r[1] is not None]
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), turns


def conversations(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        length = r.randrange(1, longest)
        role = r.choice(["system", "user"])
        for turn in range(length):
            turn = None if r.random() < 0.05 else turn + r.randrange(2)
            text = r.choice(["Yes.", "No!", "is it", "", " \t\n", "\x1c?", "é.", None, f"line {turn}.", "long " * 30 + ".", "end. \n", "ok.\xa0"])
            role = r.choice(["user", "assistant", "system", "tool", "", None, "unknown"]) if r.random() < 0.3 else {"user": "assistant", "assistant": "user"}.get(role, "user")
            rows += [(None if c == 3 else c * 7, turn, role, text)] * (1 if r.random() < 0.95 else 2)
    return rows


def expected(rows, with_damage):
    rows = [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
    out = {c: [] for c, *_ in rows}
    for row in damage(rows) if with_damage else rows:
        out[row[0]].append(row)
    return {c: brute(x) for c, x in out.items()}


@pytest.mark.parametrize("with_damage,segment,task_rows,longest", [(True, 512, 10**6, 9), (True, 3, 20, 12), (False, 4, 40, 25), (False, 1, 15, 8)])
def test_against_brute_force(spark, with_damage, segment, task_rows, longest):
    """Conversations that fit, and such as are cut into segments over many tasks."""
    rows = conversations(segment + longest, 60, longest)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, times int, part string").repartition(3)
    got = R.reports((R.damaged if with_damage else R.plain)(df), segment, task_rows).collect()
    want = {c: x[0] for c, x in expected(rows, with_damage).items()}
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want


def test_one_long_conversation(spark):
    """One conversation has nearly all rows; its repaired turns come back in order."""
    rows = [(1, i, ("user", "assistant")[i % 2] if i % 7 else "assistant", f"Turn {i % 150}" + ("." if i % 5 else "")) for i in range(400)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")] + [(1, 5, "user", "Same.")] * 200
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = expected(rows, False)
    got = {r.conv_id: tuple(r)[1:] for r in R.reports(R.plain(df), 16, 50).collect()}
    assert got == {c: x[0] for c, x in want.items()}
    turns = R.repaired(R.plain(df), 16, 50).orderBy("conv_id", "part", "seg", "i").collect()
    for c in (1, 2):
        assert [(r.role, r.text) for r in turns if r.conv_id == c] == list(want[c][1])


def test_contract_cases(spark):
    cases = {
        1: ([("user", "Hi."), ("assistant", "Yes.")], 0, "KK"), 2: ([("user", "Hi.")], 3, "KI"), 3: ([("system", "Be kind.")], 4, "D"), 4: ([("assistant", "A."), ("user", "B.")], 6, "IKKI"), 5: ([("user", "Hi")], 4, "D"),
        6: ([("user", "Q."), ("user", "R.")], 3, "KR"), 7: ([("user", "")], 4, "D"), 8: ([("user", "Q."), ("assistant", "cut")], 3, "KK"),
    }
    rows = [(c, i, *row) for c, (x, _, _) in cases.items() for i, row in enumerate(x)]
    got = {r.conv_id: (r.cost, r.audit) for r in R.reports(R.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {c: (cost, audit) for c, (_, cost, audit) in cases.items()}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.reports(R.damaged(empty)).collect() == [] and R.repaired(R.plain(empty)).collect() == []


def test_the_given_table(spark):
    from wayweft.llm import registry

    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in registry.QUERIES["op13_conversation_repair"](spark, d).collect()}
    assert got == {c: x[0] for c, x in expected(rows, True).items()}
