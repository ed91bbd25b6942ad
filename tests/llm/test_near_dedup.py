import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wayweft.llm import near_dedup as N
from wayweft.llm import wordhash


def brute_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k):
    sets = [brute_set(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = ["", None, "  \n", "one", "One", "a b c", "A  b\tC", "a b c d", "é É"]
    heads = [r.choices(vocab, k=r.randrange(5, 120)) for _ in range(20)]
    while len(texts) < n:
        words = list(r.choice(heads))
        for _ in range(r.randrange(0, 8)):
            words[r.randrange(len(words))] = r.choice(vocab)
        texts.append(" ".join(words))
    return [(i * 3 + 1, t) for i, t in enumerate(r.sample(texts, len(texts)))]


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    rows = corpus(k)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, label long").repartition(3)
    got = sorted(tuple(x) for x in N.near_groups(df, k=k).drop("key", "head").collect())
    assert got == brute(rows, k)
    if k == 5:
        assert sorted(x.doc_id for x in N.keep_one(df).collect()) == [x[0] for x in got if x[3]]


def test_rows_without_ids_of_their_own(spark):
    """Repeated and null ids, repeated rows, clashing names: rows are judged by their own texts."""
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    texts = [(5, one), (9, one), (5, two), (5, two), (None, one + " x"), (None, three), (None, three + " y"), (7, None), (7, ""), (7, ""), (None, " ")]
    df = spark.createDataFrame([(i, t, n, 0, "s") for n, (i, t) in enumerate(texts)], "doc_id long, text string, key int, head int, _winner string")
    got = N.near_groups(df, k=5).collect()
    assert len(got) == len(texts)
    assert sorted((x.doc_id, x.n_shingles) for x in got if x.component_id == 5 and x.kept) == [(5, 56), (5, 56), (5, 56)]
    assert sorted((x.doc_id or 0, x.n_shingles, x.kept) for x in got if x.component_id == 5) == [(0, 57, False), (5, 56, True), (5, 56, True), (5, 56, True), (9, 56, False)]
    assert sorted((x.n_shingles, x.kept) for x in got if x.component_id is None) == [(0, True), (56, True), (57, True)]
    kept = N.keep_one(df).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "key", "head", "_winner"}
    assert sorted((x.doc_id or 0, x.text or "") for x in kept if x.text != three and x.text != three + " y") == [(0, " "), (5, one), (5, two), (7, ""), (7, ""), (7, "")]
    assert sum((x.text or "").startswith("c0") for x in kept) == 1


def test_very_long_text(spark):
    r = random.Random(4)
    words = [f"v{r.randrange(50_000)}" for _ in range(200_000)]
    other = list(words)
    for i in range(0, 200_000, 40):
        other[i] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:150_000]))], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in N.near_groups(df, k=4).collect()) == [(1, 1), (2, 1), (3, 3)]

@pytest.mark.parametrize("few", [0, 3])
def test_large_groups_in_blocks(spark, monkeypatch, few):
    """One base with many edits: pairs of copies are often linked through others alone, and buckets are large."""
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "ITEMS", 500)
    monkeypatch.setattr(N, "GROUPS", (1, 2))
    monkeypatch.setattr(N, "SPOKESMEN", 1)
    r = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randrange(0, 7)):
            words[r.randrange(80)] = f"e{r.randrange(400)}"
        rows.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in N.near_groups(df, k=4).drop("key", "head").collect()) == brute(rows, 4)


def signed_sets():
    """v, label, items as _sets() deals them: 0, 1 and 2 are alike, 3 is not; hashes on both sides of 2**63."""
    words = [f"s{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[1:]), " ".join(words[:-1]), " ".join(words[30:] + ["x"] * 30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sets = next(N._sets(5)([batch])).column("items").to_pylist()
    assert all(min(x) < 0 < max(x) for x in sets)
    return [(v, (0, 1, 1, 2)[v], items) for v, items in enumerate(sets)]


def test_block_links_on_sets_with_both_signs():
    rows = signed_sets()
    schema = pa.schema([("v", pa.int64()), ("label", pa.int64()), ("items", pa.list_(pa.int64()))])
    members = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
    got = N._block_links(80)(None, members, members.rename_columns(["q_v", "q_label", "q_items"])).to_pydict()
    assert sorted(set(zip(got["a"], got["b"]))) == [(0, 1), (0, 2)]


def test_in_blocks_on_sets_with_both_signs(spark):
    rows = spark.createDataFrame([(7, v, len(items), label, items) for v, label, items in signed_sets()], "home long, v long, n long, label long, items array<long>")
    assert sorted(tuple(x) for x in N._in_blocks(rows.drop("items"), rows.drop("items"), rows.select("v", "items"), 80).distinct().collect()) == [(0, 1), (0, 2)]


def test_empty(spark):
    assert N.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_hashes_in_parts(monkeypatch):
    text = (" ".join(f"x{i}" * (i % 7) for i in range(500)) + "\t\n").encode()
    whole, grams = wordhash.word_hashes(text), wordhash.sequence_hashes(wordhash.word_hashes(text), 4)
    monkeypatch.setattr(wordhash, "STEP", 50)
    assert (wordhash.word_hashes(text) == whole).all()
    assert (wordhash.sequence_hashes(whole, 4) == grams).all()
    assert len(whole) == len(text.split())
    assert wordhash.minima(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def test_signature_estimates_similarity():
    c = N.Circulant(128)
    a = np.arange(1000, dtype=np.uint64)
    b = np.arange(100, 1100, dtype=np.uint64)
    same = (c.signature(a) == c.signature(b)).mean()
    assert abs(same - 900 / 1100) < 0.12
