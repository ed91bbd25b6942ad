import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wayweft.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "\n\n  a", "it's we'll 'S don''t", "x  y   z \n\n q\t", "a\x1cb \x1d c\x00", "été 日本語 😀😀 ́e", "1234567 12a3", "the " * 300, "a" * 3000, " " * 700 + "b", "<|endoftext|>", " x y　", "=-=" * 200, "\r\n\r\nx", "'re", " 's"]


@pytest.fixture(scope="module")
def both():
    ranks = B.read_ranks(PATH)
    return B.ByteBpe(PATH, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_library(both):
    own, library = both
    r = random.Random(1)
    alphabet = list("abcdethrs'  \n\t,.!12é日😀\x1c\x85") + ["the", "ing ", "'ll"]
    texts = TEXTS + ["".join(r.choices(alphabet, k=r.randrange(120))) for _ in range(3000)]
    for text, got in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(got) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "theraining", "abcdefghijklmnopqrstuvwxyz", " ", "=-"])
def test_long_matches(both, letters):
    own, library = both
    r = random.Random(len(letters))
    for n in (500, 20_000):
        text = "".join(r.choices(letters, k=n))
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_several_long_matches(both):
    """Long matches of like lengths in one batch, and a short one among them."""
    own, library = both
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60_000 + i)) for i in range(8)] + ["short"]
    began = time.time()
    got = own.encode_batch([" ".join(texts)])[0]
    assert time.time() - began < 40
    assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(" ".join(texts))


def test_a_megabyte_in_one_match(both):
    own, _ = both
    r = random.Random(2)
    text = "".join(r.choices(["the", "ing", "er", "a", "st", "on"], k=500_000))
    began = time.time()
    got = own.encode_batch([text])[0]
    assert own.decode(got) == text.encode() and time.time() - began < 120


def test_small_memory_and_matrices(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(own.cache, "limit", 10)
    monkeypatch.setattr(B, "CELLS", 64)
    for _ in range(3):
        for text, got in zip(TEXTS, own.encode_batch(TEXTS)):
            assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)


def test_pair_table(both):
    own, _ = both
    a, b = np.array([own.ranks[b"t"], -1, own.ranks[b"t"], 50_000]), np.array([own.ranks[b"h"], 3, -1, 50_000])
    assert own.table.find(a, b).tolist() == [own.ranks[b"th"], *[int(B.NONE)] * 3]


def test_query(spark, both):
    _, library = both
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (99, None, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(x) for x in B.round_trips(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = [library.encode_ordinary(t or "") for _, t, _ in rows]
    assert got == sorted(((r[0], len(x), sha(np.array(x, "<u4").tobytes()), sha((r[1] or "").encode())) for r, x in zip(rows, ids)), key=str)
    back = B.decoded(B.encoded(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted(((x.doc_id, x.text) for x in back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert B.round_trips(df.where("false"), PATH, public_tokenizers.PATTERN).collect() == []
