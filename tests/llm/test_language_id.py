import itertools
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from wayweft.llm import language_id as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute_total(word, vocab, column):
    """Sum over all segmentations, one by one."""
    word, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        if all(p in vocab or len(p) == 1 for p in parts):
            total += math.prod(column[vocab.get(p, len(vocab))] for p in parts)
    return total


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(["▁", "▁t", "t", "h", "e", "th", "he", "▁th", "▁the", "ß"])}
    p = np.random.default_rng(0).random((len(vocab) + 1, 2))
    words = ["the", "thé", "h", "tthhe", "xß"]
    lattice = L.Lattice(words, L.PieceTrie(vocab))
    got = lattice.totals(lattice.forward(p))
    for i, w in enumerate(words):
        for k in range(2):
            assert math.isclose(got[i, k], brute_total(w, vocab, p[:, k]), rel_tol=1e-12)


def test_expected_counts_are_gradients():
    vocab = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a"])}
    p = np.random.default_rng(1).random((6, 1))
    lattice, counts = L.Lattice(["ab", "aba"], L.PieceTrie(vocab)), np.array([[2.0], [3.0]])
    value = lambda q: float((counts * np.log(lattice.totals(lattice.forward(q)))).sum())
    expected = lattice.expected(p, counts)
    for i in range(6):
        q = p.copy()
        q[i] *= 1 + 1e-6
        assert math.isclose((value(q) - value(p)) / 1e-6, expected[i, 0], rel_tol=1e-3, abs_tol=1e-4)


def test_held_out_accuracy_and_labels_unused(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.95
    crossed = docs.withColumn("lang", F.when(L.remainder() == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert sorted(L.identify(crossed, PATH).collect()) == sorted(L.identify(docs, PATH).collect())
    assert {r.held_out == (L.crc_remainder(r.doc_id) == 2) for r in L.identify(docs, PATH).collect()} == {True}


def test_edges(spark):
    rows = [(1, "the cat", "en"), (2, "der hund", "de"), (3, None, None), (4, "", "en"), (5, "12 ² !?", None), (6, "x" * 100_000, None), (7, "hund", None), (7, "hund", None)]
    got = L.identify(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int"), PATH, held_out=9).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[6].lang_pred in ("en", "de") and by[7].lang_pred == "de"
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert L.identify(none, PATH).first().lang_pred == "und"
    assert L.identify(none.where("false"), PATH).collect() == []


def test_words():
    assert L.training_words("A" * 85) == ["a" * 40, "a" * 40, "a" * 5]
    assert L.words_of("A" * 85) == ["a" * 85]
    assert Counter(L.words_of("Été, été 2x")) == {"été": 2, "x": 1}


def exact_log(word, model, k):
    """The forward sum in whole fractions."""
    text, alpha = "▁" + word, [Fraction(1)] + [Fraction(0)] * (len(word) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            number = MODEL_VOCAB.get(text[start:end], len(MODEL_VOCAB) if end == start + 1 else None)
            if number is not None:
                alpha[end] += alpha[start] * Fraction(float(model.probability[number, k]))
    top = alpha[-1]
    return math.log(top.numerator) - math.log(top.denominator)


MODEL_VOCAB = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "aba", "bab"])}


def test_long_words_are_summed_whole():
    """Words beyond a lattice's width and beyond the range of doubles."""
    p = np.random.default_rng(3).random((len(MODEL_VOCAB) + 1, 2)) * [1, 1e-3]
    p[-1] = L.UNKNOWN
    model = L.Model(["x", "y"], L.PieceTrie(MODEL_VOCAB), p, np.zeros(2))
    words = ["ab" * 30, "a" * 41, "ßüö" * 13, "ab" * 200, "é" * 39 + "ab", "ab"]
    got = model.log_words(words)
    for i, w in enumerate(words):
        for k in range(2):
            assert math.isclose(got[i, k], exact_log(w, model, k), rel_tol=1e-10)


def plain_fit_predict(rows, held_out, rounds=L.ROUNDS):
    """Training and prediction word by word and segmentation by segmentation, without lattices or memory."""
    vocab = L.vocabulary(PATH)
    taught = [(t, k) for i, t, k in rows if t is not None and k is not None and L.crc_remainder(i) != held_out]
    names = sorted({k for _, k in taught})
    table = {k: [1 / (len(vocab) + 1)] * len(vocab) for k in names}
    most = max(map(len, vocab))

    def arcs(word):
        text = "▁" + word
        return [(a, b, vocab.get(text[a:b], -1)) for b in range(1, len(text) + 1) for a in range(max(0, b - most), b) if text[a:b] in vocab or b == a + 1]

    def sums(word, p, found):
        alpha = [1.0] + [0.0] * (len(word) + 1)
        for a, b, n in found:
            alpha[b] += alpha[a] * (p[n] if n >= 0 else L.UNKNOWN)
        return alpha

    counts = {k: Counter(w for t, lang in taught if lang == k for w in L.training_words(t)) for k in names}
    for _ in range(rounds):
        for k in names:
            want = [0.01] * len(vocab)
            for word, times in counts[k].items():
                found = arcs(word)
                alpha, beta = sums(word, table[k], found), [0.0] * (len(word) + 1) + [1.0]
                for a, b, n in sorted(found, key=lambda x: -x[1]):
                    beta[a] += (table[k][n] if n >= 0 else L.UNKNOWN) * beta[b]
                for a, b, n in found:
                    if n >= 0:
                        want[n] += times * alpha[a] * table[k][n] * beta[b] / alpha[-1]
            table[k] = [x / sum(want) for x in want]
    prior = {k: math.log(sum(x == k for _, x in taught) / len(taught)) for k in names}
    out = []
    for i, t, _ in rows:
        words = L.words_of(t or "")
        if not words:
            out.append((i, "und", 0.0))
            continue
        logs = {k: prior[k] + sum(math.log(sums(w, table[k], arcs(w))[-1]) for w in words) for k in names}
        best = max(names, key=lambda k: (logs[k], [-ord(c) for c in k]))
        out.append((i, best, 1 / sum(math.exp(logs[k] - logs[best]) for k in names)))
    return out


def test_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()
    rows = [(d.doc_id, " ".join(d.text.split()[:40]), d.lang) for d in docs] + [(1000, None, "en"), (1001, "", None), (1002, "unlabelled words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(df, PATH, held_out=2).collect()}
    for i, name, score in plain_fit_predict(rows, 2):
        assert got[i].lang_pred == name and math.isclose(got[i].score, score, rel_tol=1e-6, abs_tol=1e-9)


def test_null_ids_and_clear_rows(spark):
    rows = [(None, "the cat and the dog", "en"), (1, "der hund und die katze", "de"), (1, "the house", "en"), (2, "...", None), (None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, _good string")
    assert sorted((r.doc_id or 0, r.lang_pred) for r in L.identify(df, PATH, held_out=9).collect()) == [(0, "en"), (0, "und"), (1, "de"), (1, "en"), (2, "und")]
    kept = L.clear(df, L.train(L.labelled(df), PATH), 0.5)
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == ["der hund und die katze", "the cat and the dog", "the house"]


def test_many_languages_in_bounded_memory(monkeypatch):
    """With 60 languages few words are summed at once and few remembered; what comes out is the same."""
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcdefghij"), size=r.integers(1, 9))) for _ in range(900)]
    counts = {f"l{k:02}": Counter({w: 1 + int(r.integers(20)) for w in words[10 * k : 10 * k + 200]}) for k in range(60)}
    model = L.fit(counts, dict.fromkeys(counts, 5), L.vocabulary(PATH), 1)
    texts = [" ".join(words[i : i + 30]) for i in range(0, 900, 9)] + [None, "", "12"]
    want = L.Scorer(model).predict(texts)
    monkeypatch.setattr(L, "AT_ONCE", 60)
    monkeypatch.setattr(L, "CACHE_SUMS", 3000)
    scorer = L.Scorer(model)
    for i, text in enumerate(texts):
        one = scorer.predict([text])
        assert one[0][0] == want[0][i] and math.isclose(one[1][0], want[1][i], rel_tol=1e-9)
        assert len(scorer.rows) * 60 <= 3000 + 60 * 30 and len(scorer.table) <= 2048
    assert L._at_once(model.languages) == 100
