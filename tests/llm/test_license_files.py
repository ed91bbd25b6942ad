"""Every digest of a whole licence, with the text where the system has it, and the same text in other spellings."""

import pathlib

import pytest

from wayweft.llm import license_scan, license_texts

FOLDER = pathlib.Path("/usr/share/common-licenses")
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts on this system")
def test_whole_texts_of_the_digests(spark):
    assert set(FILES.values()) == set(license_texts.DIGESTS)
    texts = {name: (FOLDER / file).read_text(encoding="utf-8", errors="replace") for file, name in FILES.items() if (FOLDER / file).exists()}
    rows = [(i, name, form) for i, (name, text) in enumerate(texts.items()) for form in (text, text.upper().replace("\n", "\r\n"), "  " + text.replace(",", "").replace("license", "licence"), text + " One word more.")]
    df = spark.createDataFrame([(10 * i + n % 4, form) for n, (i, _, form) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(df).collect()}
    want = {10 * i + n % 4: name if n % 4 < 3 else None for n, (i, name, _) in enumerate(rows)}
    assert got == want and len(texts) >= 10
