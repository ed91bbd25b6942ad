import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayweft.llm import packing as P
from wayweft.llm.word_tokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "The cat's  hat,\n\nit's 3 o'clock\x1cnow", "ÉTÉ İstanbul ß ΣΑΣ", "á e ́ x y z\u0085w", "<|endoftext|> a<|startoftext|>b", "don't we'll I'd", "x" * 9000, "日本語 テキスト", "\t \n", "퟿😀😀"]


def test_ids_match_the_library():
    t = Tokenizer.from_file(PATH)
    r = random.Random(0)
    alphabet = list("abcdE'stréÀÿºµİŉſĀž \n\t  ,.!12́İΣ\x1d\x00") + ["'ll", "😀", "the ", "averylongwordindeed", "\xa0", "“", "’s", "<|endoftext|>"]
    texts = TEXTS + ["".join(r.choices(alphabet, k=r.randrange(80))) for _ in range(2000)]
    for limit in (50, 100_000):
        w = WordTokens(PATH, limit)
        for at in range(0, len(texts), 30):
            for text, got in zip(texts[at : at + 30], w.encode_texts(texts[at : at + 30])):
                assert got.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def check(bins, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in bins) <= capacity
    assert -(-sum(lengths) // capacity) <= len(bins)


@pytest.mark.parametrize("seed", range(5))
def test_evolve_never_loses_an_item(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 5, r.randrange(1, 100)]) for _ in range(300)]
    found = P.evolve(lengths, 100, seed, generations=10)
    check(found.bins, lengths, 100)
    assert len(found.bins) <= found.plain


def planted(seed, bins):
    """Three pieces fill each bin exactly."""
    r, out = random.Random(seed), []
    for _ in range(bins):
        a = r.randint(380, 490)
        b = r.randint(250, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_crossover_saves_bins(seed, monkeypatch):
    """Best fit by decreasing length, and any number of other orders, need more bins than crossover does."""
    lengths = planted(seed, 40)
    found = P.evolve(lengths, 1000, seed)
    check(found.bins, lengths, 1000)
    assert found.children and found.stayed and len(found.bins) <= found.plain - 4
    monkeypatch.setattr(P, "crossover", lambda mine, *_: mine)
    without = P.evolve(lengths, 1000, seed)
    assert len(without.bins) >= len(found.bins) + 3 and not without.stayed


def fewest(lengths, capacity):
    """The least number of bins, by trying all places of each item in turn."""
    best = [len(lengths)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(rooms)
            return
        for n, room in enumerate(rooms):
            if room >= lengths[at] and room not in rooms[:n]:
                place(at + 1, [*rooms[:n], room - lengths[at], *rooms[n + 1 :]])
        place(at + 1, [*rooms, capacity - lengths[at]])

    place(0, [])
    return best[0]


def test_small_cases_against_the_optimum():
    r, saved = random.Random(6), 0
    for case in range(60):
        lengths = planted(case, 3) if case % 3 == 0 else [r.randint(100, 600) for _ in range(9)]
        found = P.evolve(lengths, 1000, case, generations=10)
        check(found.bins, lengths, 1000)
        assert len(found.bins) == fewest(sorted(lengths, reverse=True), 1000)
        saved += found.plain - len(found.bins)
    assert saved > 5


def valid(rows, capacity=4096):
    sequences = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.pack(P.pieces(docs, PATH)).collect()
    t, by = Tokenizer.from_file(PATH), {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    total = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        parts = sorted(by[doc_id], key=lambda x: x.piece)
        assert [x.piece for x in parts] == list(range(-(-len(ids) // 4096)))
        for x in parts:
            assert x.start == 4096 * x.piece and x.length == min(4096, len(ids) - x.start)
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
    assert valid(got) <= 1.002 * total / 4096 + 1


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "PROBLEM", 60)
    rows = [(i // 2, i % 2, 0, n, i) for i, n in enumerate(planted(3, 100) + [1000] * 40)] + [(1, 0, 0, 7, 7)] * 3
    report = []
    got = P.pack(spark.createDataFrame(rows, P.PIECES), 1000, report=report).collect()
    assert sorted((x.doc_id, x.piece, x.length) for x in got) == sorted((x[0], x[1], x[3]) for x in rows)
    assert valid(got, 1000) <= 148
    pieces, problems, plain, bins, children, stayed = report[0]
    assert pieces == 303 and problems == 6 and bins <= plain - 10 and children > stayed > 0 and len(report) > 1


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0, 1), (2, "", 0, 1), (2, "", 0, 1), (None, "a", 0, 1), (None, None, 0, 1), (3, "word " * 20_000, 0, 1)], "doc_id long, text string, length int, no int")
    got = P.pack(P.pieces(df, PATH)).collect()
    valid(got)
    assert sorted(x.length for x in got if x.doc_id in (1, 2)) == [1, 1, 1] and sum(x.length for x in got if x.doc_id == 3) == 20_001
    assert sorted(x.length for x in got if x.doc_id is None) == [1, 2]
    assert P.pack(P.pieces(df.where("false"), PATH)).collect() == []
