import hashlib
import random
import re

import pytest

from wayweft.llm import fill_middle as M

UNITS = {"code_points": r"[\s\S]", "lines": r"[^\n]*\n|[^\n]+", "words": r"^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}


def texts():
    r = random.Random(5)
    pick = ["a", "é", "日", "😀", " ", "\n", "\t", "\x1c", "é", "word ", "<", "P>"]
    return ["", "x", " ", "\n", " \n a", "日本", "ab<P>cd", "<S>", "e<M>", "<<P", "ends <", *("".join(r.choices(pick, k=r.randrange(1, 400))) for _ in range(150)), "é" * 9000 + " z\n" * 3000]


@pytest.mark.parametrize("unit", UNITS)
def test_checkpoints(unit):
    """Every cut of every text, over steps and spacings that part units and characters."""
    for text in texts():
        units = re.findall(UNITS[unit], text)
        assert "".join(units) == text
        for every, step in ((1, 1 << 20), (3, 7), (64, 5000)):
            index = M.Checkpoints(text.encode(), unit, every, step)
            assert (index.n, index.points) == (len(units), len(text)) and len(index.units) == -(-len(units) // every)
            chars = size = 0
            cuts = range(len(units) + 1) if len(units) < 500 else (0, 1, 777, len(units) - 1, len(units))
            for u in cuts:
                before = "".join(units[:u])
                chars, size = len(before), len(before.encode())
                assert index.cut(u) == (size, chars), (unit, text, u)


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)
    return doc_id, n, "psm", a, b - a, sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def test_against_brute_force(spark):
    rows = [(i if i % 9 else None, t) for i, t in enumerate([None, *texts(), None, "twice", "twice"])] + [(3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "psm", 1) for i, t in rows], "doc_id long, text string, form string, h1 int").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in M.digests(M.transform(df, every=16)).collect()), key=key)
    assert got == sorted((brute(*r) for r in rows), key=key) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.digests(M.transform(df.where("false"))).collect() == []


@pytest.mark.parametrize("unit", UNITS)
def test_outputs_rebuild_the_text(spark, unit):
    rows = list(enumerate(texts()))
    cut = M.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, cut_percent=100, spm_percent=50)
    got = {r.doc_id: r for r in cut.withColumn("back", M.restored()).collect()}
    assert {i: r.back for i, r in got.items()} == dict(rows)
    for i, t in rows:
        units, r = re.findall(UNITS[unit], t), got[i]
        assert r.n == len(units)
        if r.form != "plain":
            edges = [0]
            for u in units:
                edges.append(edges[-1] + len(u))
            assert r.prefix_chars in edges and r.prefix_chars + r.middle_chars in edges
