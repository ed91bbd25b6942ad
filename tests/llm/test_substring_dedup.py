import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayweft.llm import substring_dedup as S
from wayweft.llm import wordhash


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for i, w in enumerate(words):
        for j in range(len(w) - window + 1):
            seen.setdefault(tuple(w[j : j + window]), []).append((i, j))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i].update(range(j, j + window))
    out = []
    for (d, _), w, g in zip(rows, words, gone):
        kept = " ".join(x for n, x in enumerate(w) if n not in g)
        out.append((d, len(w), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, window):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "é", "日本", "x\x1cy", "z\x85"] + [f"w{i}" for i in range(60)]
    passages = [r.choices(vocab, k=r.choice([window - 1, window, window + 1, 3 * window])) for _ in range(12)]
    texts = [None, "", " \t", "a", " ".join(["a"] * (window + 3)), " ".join(["p", "q"] * window), " ".join(r.choices(vocab, k=4000))]
    while len(texts) < 120:
        words = []
        for _ in range(r.randrange(1, 6)):
            words += r.choice(passages) if r.random() < 0.4 else r.choices(vocab, k=r.randrange(1, 60))
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    texts += [texts[40], texts[6]]
    return [(None if i % 50 == 7 else i // 2 if i > 110 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window,block,shard,broadcast,hot", [(35, 2 << 20, 100_000, 1 << 30, 32), (35, 2 << 20, 20_000, 0, 32), (35, 3000, 60, 0, 2), (6, 5000, 1000, 0, 4)])
def test_against_brute_force(spark, monkeypatch, window, block, shard, broadcast, hot):
    """By one broadcast automaton, by shards, and with hot anchors."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus(window + block, window)
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, block int, again binary").repartition(3)
    key = lambda x: (x[0] is not None, *x[1:], x[0] or 0)
    assert sorted((tuple(x) for x in S.removals(df, window, block, shard, broadcast).collect()), key=key) == sorted(brute(rows, window), key=key)


def test_hashes_only_route(spark, monkeypatch):
    """With hashes that take many groups of words for equal, the words still decide."""
    true = wordhash.sequence_hashes
    monkeypatch.setattr(wordhash, "sequence_hashes", lambda words, k: true(words, k) % np.uint64(5))
    r = random.Random(1)
    passage = [f"p{i}" for i in range(50)]
    texts = [[f"x{r.randrange(10**6)}" for _ in range(100)] + (passage if i % 3 == 0 else []) for i in range(30)]
    groups = [S.anchor_places(wordhash.word_hashes(" ".join(t).encode()), 35) for t in texts]
    assert len(set(np.concatenate([g for g, _ in groups]).tolist())) == 5
    candidates = S.Candidates(pa.table({"again": [np.arange(5, dtype=np.uint64).tobytes()], "hot": [b""]}), 35)
    found = [(i, at, p) for i, t in enumerate(texts) for _, at, p in candidates.of(" ".join(t).encode(), [w.encode() for w in t])]
    spans = S.repeated([(p, 1) for _, _, p in found], 35)
    gone = {(i, at + w) for (i, at, _), s in zip(found, spans) for a, b in s for w in range(a, b)}
    assert gone == {(i, 100 + w) for i in range(0, 30, 3) for w in range(50)}


def test_texts_and_empty(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"x {passage} y"), (2, f"{passage} z"), (3, "only me")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in S.deduplicated(df).collect()} == {1: "x y", 2: "z", 3: "only me"}
    assert S.removals(df.where("false")).collect() == []


def test_automaton_matches():
    r = random.Random(0)
    for _ in range(200):
        references = [([r.randrange(3) for _ in range(r.randrange(1, 30))], r.randrange(1, 3)) for _ in range(4)]
        automaton = S.SuffixAutomaton()
        for x, n in references:
            automaton.add(x, n)
        automaton.settle()
        times = Counter()
        for x, n in references:
            for a in range(len(x) - 3):
                times[tuple(x[a : a + 4])] += n
        text = [r.randrange(3) for _ in range(60)]
        for least in (1, 2, 3):
            want = {i for a in range(57) if times[tuple(text[a : a + 4])] >= least for i in range(a, a + 4)}
            got = automaton.spans(text, 4, least)
            assert {i for a, b in got for i in range(a, b)} == want
