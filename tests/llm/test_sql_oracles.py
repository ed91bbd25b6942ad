import pathlib

import duckdb
import pytest

from wayweft.llm import license_scan, license_texts, registry, url_filter

DIR = "/root/testdata/sf0.01"


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con.sql(sql).to_arrow_table()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    want = duck(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    key = lambda r: tuple(str(x) for x in r)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    assert rows == sorted((tuple(r[c] for c in columns) for r in want.to_pylist()), key=key) and rows


def test_licences_in_other_spellings(spark):
    title, mit = license_texts.LICENSES["MIT"]
    cases = [
        (1, f"{title}\r\n\r\nCopyright (c) 2020 A. N. Other\nCopyright 2021, B\n\n{mit.replace('sublicense', 'sub-license').upper()}", "MIT"),
        (2, mit.replace('"', "“") + " And more.", None),
        (3, mit.replace(". ", ".\n   * "), "MIT"),
        (4, None, None),
        (5, "", None),
        (6, "# All rights reserved.\n" + license_texts.LICENSES["BSD-2-Clause"][1], "BSD-2-Clause"),
        (7, "prose\n  Released under the MIT Licence\nLicensed under the Apache License, Version 2.0.\nReleased under the mit license!", None),
        (8, "x " * 200_000, None),
        (8, "x", None),
    ]
    got = license_scan.scan(spark.createDataFrame([(i, t, "n") for i, t, _ in cases] + [(None, mit, "n")], "doc_id long, text string, license string")).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got if r.license) == [(0, "MIT"), *[(i, n) for i, _, n in cases if n]]
    assert {r.notices for r in got if r.doc_id == 7} == {"Apache-2.0,MIT"} and len(got) == 10
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    digests = [r.text_digest for r in license_scan.known(spark).collect()]
    assert len(digests) == len(set(digests))


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_captures(spark, broadcast):
    dated = [("l", "host", "A.com", "add", 10), ("l", "host", "a.com", "remove", 20), ("l", "domain", "b.com", "add", 5), ("l", "domain", "b.com", "add", 15), ("m", "prefix", "c.com/x/y", "add", 0), ("m", "host", "d.com", "add", 7), ("m", "host", "d.com", "remove", 7), (None, "host", "a.com", "add", 0), ("l", None, None, "add", 0), ("l", "host", "a.com", "add", 10)]
    cases = [
        (1, "http://a.com/", 9, ""), (2, "HTTP://u:p@A.com.:80/q", 10, "l:host:a.com"), (3, "https://a.com", 20, ""), (4, "https://x.y.b.com/?a", 16, "l:domain:b.com"), (5, "https://bb.com/", 16, ""),
        (6, "ftp://c.com/x/y/z", 1, "m:prefix:c.com/x/y"), (7, "ftp://c.com/x/yz", 1, ""), (8, "http://d.com", 8, ""), (9, None, 8, ""), (10, "not a url", 8, ""), (11, "http://a.com", None, ""), (12, "http:///x", 1, ""), (4, "https://x.y.b.com/?a", 16, "l:domain:b.com"),
    ]
    captures = spark.createDataFrame([(i, u, t, "q") for i, u, t, _ in cases], "page_id long, url string, fetched long, key string")
    got = url_filter.filter_captures(captures, url_filter.entries(spark, dated), broadcast).collect()
    assert sorted((r.page_id, r.matches, r.blocked) for r in got) == sorted((i, m, bool(m)) for i, _, _, m in cases)
    assert not any(r.blocked for r in url_filter.filter_captures(captures, url_filter.entries(spark, [])).collect())
    assert url_filter.filter_captures(captures.where("false"), url_filter.entries(spark, dated)).collect() == []


def test_prefix_keeps_the_case_of_its_path(spark):
    dated = [("a", "prefix", "Example.ORG/Docs", "add", 0), ("b", "domain", "Example.ORG", "add", 10)]
    rows = [(1, "http://EXAMPLE.org/Docs/x", 5), (2, "http://example.org/docs/x", 5), (3, "http://example.org/Docs", 15)]
    got = url_filter.filter_captures(spark.createDataFrame(rows, "page_id long, url string, fetched long"), url_filter.entries(spark, dated)).collect()
    assert {r.page_id: r.matches for r in got} == {1: "a:prefix:example.org/Docs", 2: "", 3: "a:prefix:example.org/Docs,b:domain:example.org"}


FOLDER = pathlib.Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3"}


def test_known_texts_planted_among_documents(spark):
    """Whole texts, as published and in other spellings, among documents that only hold or quote them."""
    plain = [(name, f"{title}\n\nCopyright (c) 1999 Someone\n\n{body}") for name, (title, body) in license_texts.LICENSES.items()]
    plain += [(name, (FOLDER / file).read_text()) for file, name in FILES.items() if (FOLDER / file).exists()]
    rows = []
    for i, (name, text) in enumerate(plain):
        rows += [(10 * i, text, name), (10 * i + 1, text.upper().replace("\n", "\r\n"), name), (10 * i + 2, text.replace(",", " ,").replace("license", "licence"), name), (10 * i + 3, f"{text}\nmore", None), (10 * i + 4, text[:-40], None)]
    got = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == {i: n for i, _, n in rows}


def test_prefixes(spark):
    """Closing slashes, whole hosts, cases, and a hostile URL of very many parts."""
    dated = [("a", "prefix", "c.com/x/", "add", 0), ("b", "prefix", "C.com/X", "add", 0), ("c", "prefix", "d.com/", "add", 0), ("d", "prefix", "d.com", "add", 0), ("e", "prefix", "c.com/x/y//", "add", 0)]
    cases = [(1, "http://c.com/x", "a:prefix:c.com/x"), (2, "http://C.com/X/y", "b:prefix:c.com/X"), (3, "http://c.com/x/y/z?q", "a:prefix:c.com/x,e:prefix:c.com/x/y"), (4, "http://c.com/xx", ""), (5, "http://d.com", "c:prefix:d.com,d:prefix:d.com"), (6, "http://d.com/", "c:prefix:d.com,d:prefix:d.com"), (7, "http://c.com/x/" + "a/" * 100_000, "a:prefix:c.com/x"), (8, "http://" + "h." * 50_000 + "d.com/q", "")]
    got = url_filter.filter_captures(spark.createDataFrame([(i, u, 5) for i, u, _ in cases], "page_id long, url string, fetched long"), url_filter.entries(spark, dated)).collect()
    assert {r.page_id: r.matches for r in got} == {i: m for i, _, m in cases}
