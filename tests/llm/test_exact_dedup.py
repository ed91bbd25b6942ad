import hashlib
import random

import pytest

from wayweft.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        first = i == max(ids) and not any(o[1:3] == (t or "", True) for o in out)
        out.append((i, t or "", first, max(ids), len(ids)))
    return sorted((i, top, n, kept, hashlib.sha256(t.encode()).hexdigest()) for i, t, kept, top, n in out)


@pytest.mark.parametrize("limit", [300, 5000, 1 << 30])
def test_trie_spills_and_finds_all(limit):
    r = random.Random(limit)
    keys = [bytes(r.choice(b"abc") for _ in range(r.randrange(0, 12))) for _ in range(3000)]
    trie = E.PatriciaTrie(E._merge, limit)
    want = {}
    for i, k in enumerate(keys):
        trie.insert(E._key(k), [i, 1, [i]])
        want.setdefault(k, []).append(i)
    got = sorted((v[0], v[1], sorted(v[2])) for v in trie.items())
    assert got == sorted((min(v), len(v), v) for v in want.values())


@pytest.mark.parametrize("limit", [2000, 1 << 30])
def test_against_brute_force(spark, limit):
    r = random.Random(5)
    texts = ["", None, "a", "a\n", "é" * 50, "x" * 200_000, "x" * 199_999 + "y"] + ["".join(r.choices("ab ", k=r.randrange(9))) for _ in range(40)]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(7, "a"), (7, "a")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = E.exact_groups(df, limit=limit).drop("key").collect()
    assert sorted(tuple(x) for x in got) == brute(rows)
    kept = E.keep_one(df).collect()
    assert sorted(x.doc_id for x in kept) == [x[0] for x in brute(rows) if x[3]]
    assert kept[0].__fields__ == ["doc_id", "text", "kept"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert E.exact_groups(empty).collect() == [] and E.keep_one(empty).collect() == []


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_null_and_repeated_ids(spark, keep):
    """Rows are chosen, not ids; clashing names do no harm."""
    rows = [(5, "a"), (9, "a"), (5, "b"), (None, "a"), (None, "c"), (None, "c"), (9, "a"), (7, None), (7, "")]
    df = spark.createDataFrame([(i, t, n, "w") for n, (i, t) in enumerate(rows)], "doc_id long, text string, copies int, _winner string")
    got = E.exact_groups(df, keep).collect()
    top = 9 if keep == "largest" else 5
    assert sorted((x.doc_id or 0, x.keep_id or 0, x.group_size) for x in got) == sorted([(0, top, 4), (5, top, 4), (9, top, 4), (9, top, 4), (5, 5, 1), (0, 0, 2), (0, 0, 2), (7, 7, 2), (7, 7, 2)])
    assert sum(x.kept for x in got) == 4
    kept = E.keep_one(df, keep)
    assert kept.columns == df.columns and sorted((x.doc_id or 0, x.text or "") for x in kept.collect()) == sorted([(top, "a"), (5, "b"), (0, "c"), (7, "")])
