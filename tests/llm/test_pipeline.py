import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as C
from wayweft.llm import packing, scratch, secret_scan
from wayweft.llm import near_dedup as N


def brute_near(rows):
    """rows of (id, text): the smallest id of each group of five-word shingle sets linked at 0.8."""
    sets = {i: set(N.shingle_set(t, 5).tolist()) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[max(top(i), top(j))] = min(top(i), top(j))
    return {i for i in ids if top(i) == i}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(150).collect()
    rows = [(d.doc_id, d.text, d.lang, d.source, d.n_chars) for d in docs]
    for i, d in enumerate(r.sample(docs, 30)):
        words = d.text.split()
        if i % 2 and len(words) > 20:
            words[3] = "changed"
        text = d.text if i % 3 == 0 else " ".join(words)
        rows.append((10_000 + i, text, d.lang, d.source, len(text)))
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "s", 0), (20_002, "123 !!", "en", "s", 6), (20_003, "the and of with password = abcdefabcdef0123 and the others are here to be found", "en", "s", 80)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages_against_brute_force(spark, small):
    path, rows = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    by = dict(C.STAGES)
    one = scratch.materialise(by["language_id"](spark, docs, path), "t1")
    assert one.columns == docs.columns
    gone = {r[0] for r in rows} - {r.doc_id for r in one.collect()}
    assert {20_000, 20_001, 20_002} <= gone and len(gone) <= 3 + 4
    two = scratch.materialise(by["exact_dedup"](spark, one, path), "t2")
    last = {}
    for r in one.collect():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(last.values())
    three = scratch.materialise(by["near_dedup"](spark, two, path), "t3")
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == brute_near([(r.doc_id, r.text) for r in two.collect()])
    four = scratch.materialise(by["secret_scan"](spark, three, path), "t4")
    assert four.columns == docs.columns and four.count() == three.count()
    for r in four.join(three.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        assert r.text == secret_scan.redact(r.was, secret_scan.find(r.was)) and r.n_chars == len(r.text)
    five = by["best_fit_packing"](spark, four, path).collect()
    assert {r.doc_id for r in five} == {r.doc_id for r in four.collect()}
    whole = C.run(spark, path).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, five))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_every_stage_judges_rows(spark, tmp_path):
    """Null, repeated ids, repeated rows, empty and long texts, and columns with names that stages use themselves."""
    en = "the people of the town are going to the house with the others and they will have been there for the day"
    de = "die leute in der stadt sind mit den anderen in das haus gegangen und werden dort den ganzen tag lang sein"
    key = "password = abcdefabcdef0123"
    rows = [(5, en), (9, en), (5, de), (5, de), (None, f"{en} {key}"), (None, None), (3, ""), (4, "?!"), (7, "the and of with " * 30_000), (None, f"{de} {key} {key}")]
    columns = "doc_id long, text string, lang string, _winner int, _good string, key int, copies int, v string"
    df = spark.createDataFrame([(i, t, ("en" if t == en else "de" if t == de else None), n, "g", n, 1, "v") for n, (i, t) in enumerate(rows)], columns)
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in C.STAGES[:-1]:
        out = scratch.materialise(stage(spark, docs, str(tmp_path)), "edge")
        assert out.columns == docs.columns
        docs = out
        seen.append(sorted((r.doc_id or 0, (r.text or "")[:3], len(r.text or "")) for r in docs.collect()))
    short = [(0, en[:3], len(en) + 28), (0, de[:3], len(de) + 56), (5, "die", len(de)), (7, "the", 480_000)]
    assert seen[0] == sorted([*short, (5, "die", len(de)), (5, "the", len(en)), (9, "the", len(en))])
    assert seen[1] == sorted([*short, (9, "the", len(en))])
    assert (7, "the", 480_000) in seen[2] and len(seen[2]) == len(brute_near(list(enumerate(dict.fromkeys(t for _, t in rows if t and len(t) > 5)))))
    assert len(seen[3]) == len(seen[2]) and not any("abcdefabcdef" in r.text for r in docs.collect())
    packed = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and sum(r.piece == 0 for r in packed) == docs.count()


def test_workers_let_go_of_what_other_stages_keep(spark, small):
    """A word's sums and a chunk's ids are kept from task to task of their own stage alone, without waiting for Python's
    collection of cycles: the stages run in the same workers, and what each left there added up."""
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").repartition(8)

    def held(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(type(x).__name__ in ("Scorer", "Model", "WordTokens") for x in gc.get_objects())], pa.int64())})

    count = lambda: [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()]
    assert C.language(spark, docs, small[0]).count()
    assert sum(count()) == 0
    assert packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).count()
    assert sum(count()) == 0
