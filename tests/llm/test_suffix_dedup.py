import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wayweft.llm import suffix_dedup as S
from wayweft.llm.suffix_index import Family, suffix_array


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if times[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, window):
    r = random.Random(seed)
    vocab = ["a", "of the", "é", "日本", "x\x1cy", "\n", "😀"] + [f"w{i}" for i in range(80)]
    words = lambda n: " ".join(r.choices(vocab, k=n))
    passages = ["".join(words(window))[: r.choice([window - 1, window, window + 1, 3 * window])] for _ in range(8)]
    common = words(window)[: window - 25]  # common to many texts, though shorter than a window
    texts = [None, "", "a", "a" * (window + 7), "ab" * window, "a" * 3 * window, words(4 * window)]
    while len(texts) < 70:
        texts.append("".join(r.choice([words(r.randrange(1, window // 4)), r.choice(passages)]) for _ in range(r.randrange(1, 5))))
    texts += [words(30) + common + words(30) for _ in range(30)] + [texts[40], texts[6], texts[6][: 2 * window]]
    return [(None if i % 50 == 7 else i // 2 if i > 100 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window,block,shard,batch,hot", [(400, 4 << 20, 4 << 20, 1 << 19, 4096), (400, 20_000, 10_000, 4_000, 4096), (64, 10_000, 5_000, 1_000, 3), (100, 10_000, 1 << 20, 3_000, 8)])
def test_against_brute_force(spark, window, block, shard, batch, hot):
    """In one batch, over many levels and shards, and with routes that are parted down to windows."""
    rows = corpus(window + block, window)
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, block int, again binary").repartition(3)
    key = lambda x: (x[0] is not None, *x[1:], x[0] or 0)
    got = sorted((tuple(x) for x in S.removals(df, window, block, shard, batch, hot).collect()), key=key)
    assert got == sorted(brute(rows, window), key=key) and any(x[3] > 1 for x in got)


def test_kept_bytes_and_empty(spark):
    passage = "é" * 220
    df = spark.createDataFrame([(1, f"x {passage} y"), (2, f"{passage} z"), (3, "only me")], "doc_id long, text string")
    assert {x.doc_id: bytes(x.kept) for x in S.deduplicated(df).collect()} == {1: b"x y", 2: b"z", 3: b"only me"}
    assert S.removals(df.where("false")).collect() == []


@pytest.mark.parametrize("window", [8, 13, 40])
def test_suffix_array(window):
    r = random.Random(window)
    for alphabet in (b"a", b"ab", bytes(range(256))):
        passages = [bytes(r.choices(alphabet, k=r.randrange(0, 90))) for _ in range(20)]
        data = b"".join(passages)
        stops = np.cumsum([len(p) for p in passages])
        at, new = suffix_array(np.frombuffer(data + bytes(8), np.uint8), np.repeat(stops, [len(p) for p in passages]), window)
        want = sorted(data[s - len(p) + i : s - len(p) + i + window] for p, s in zip(passages, stops) for i in range(len(p) - window + 1))
        assert [data[i : i + window] for i in at] == want
        assert new.tolist() == [i == 0 or want[i] != want[i - 1] for i in range(len(want))]


def test_family_of_many_batches():
    """Levels stay in order and hold each window once; what recurs is what a count says, whatever the batches."""
    r = random.Random(3)
    for window in (8, 21):
        family, passages, recurs = Family(window), [], []
        for _ in range(23):
            some = [bytes(r.choices(b"abc", k=r.randrange(1, 60))) for _ in range(r.randrange(1, 9))]
            flags = [r.random() < 0.1 for _ in some]
            family.add(some, flags)
            passages += some
            recurs += flags
        assert [level is not None for level in family.levels] == [x == "1" for x in f"{23:b}"[::-1]]
        data = family.data.tobytes()
        held = [data[i : i + window] for level in family.levels if level for i in level.at]
        assert len(held) == len(set(held)) == len({p[i : i + window] for p in passages for i in range(len(p) - window + 1)})
        for level in family.levels:
            if level:
                own = [data[i : i + window] for i in level.at]
                assert own == sorted(own)
        times = Counter(p[i : i + window] for p, twice in zip(passages, recurs) for i in range(len(p) - window + 1) for _ in range(1 + twice))
        got = {(i, at) for i, a, b in family.spans() for at in range(a, b)}
        assert got == {(n, at) for n, p in enumerate(passages) for i in range(len(p) - window + 1) if times[p[i : i + window]] > 1 for at in range(i, i + window)}


def test_parts_keep_equal_windows_together():
    r = random.Random(9)
    window, anchor = 100, 60
    left, core, right = (bytes(r.choices(b"abcdef", k=n)) for n in (80, 90, 80))
    one, two = left[-60:] + core + right[:40], b"?" * 5 + left[-50:] + core + right[:30] + b"!"
    for width in (1, 8, 9):
        routes = [{}, {}]
        for into, passage, at in ((routes[0], one, anchor), (routes[1], two, 55)):
            for low, route, place, some in S.parts(passage, at, 7, window, width):
                assert passage[low : low + len(some)] == some and place == at - low
                for i in range(len(some) - window + 1):
                    into.setdefault(some[i : i + window], set()).add(route)
        assert all(len(x) == 1 for x in (*routes[0].values(), *routes[1].values()))
        both = set(routes[0]) & set(routes[1])
        assert both and all(routes[0][w] == routes[1][w] for w in both)


def test_the_given_table(spark):
    from wayweft.llm import registry

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in registry.QUERIES["op11_suffix_dedup"](spark, d).collect()) == sorted(brute(rows, 400))


def test_passages_do_not_hang_on_the_order_of_rows(monkeypatch):
    """A block's rows come in another order each time they are shuffled; its steps then end elsewhere."""
    r = random.Random(5)
    texts = [bytes(r.choices(b"abcdefgh \n", k=r.choice([0, 30, 99, 100, 101, 700, 3000]))) for _ in range(40)]
    texts += [b"", b"a" * 900, texts[7], b"ab" * 300]
    monkeypatch.setattr(S, "STEP", 257)

    def passages(some):
        block = S.Block(some)
        again = np.unique(block.runs(100)[3])
        return Counter((route, at, passage) for route, _, at, passage in S._candidates(block, 100, again))

    want = passages(texts)
    for _ in range(5):
        r.shuffle(texts)
        assert passages(texts) == want
    monkeypatch.setattr(S, "STEP", 1 << 18)
    assert passages(texts) == want and sum(want.values()) > 300
