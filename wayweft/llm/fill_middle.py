"""Fill-in-middle: whole texts cut into prefix, middle and suffix, put in another order with markers, and restored.

A text is counted in units (code points, words, or lines) in one pass over its UTF-8 bytes, which records the byte and the
code-point offset of every EVERY-th unit: a sparse index of checkpoints. A cut at unit u is found by binary search among
the checkpoints and a short rescan from there, so a text of any length costs two offsets for each EVERY units and no
array of all its units.

Results: one row per row of the table, whatever its id (null and repeated ids are ordinary; a null id counts as an empty
word in what is hashed). A null text is an empty one. Texts that are empty, that hold a marker, or that the hash leaves
alone are plain: their output is the text itself, and prefix_chars and middle_chars are null. An empty table gives no
row; other columns are ignored, whatever their names. Markers come in once, so restoring is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

#: The markers of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are cut, and of those that get the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20
#: Units between two checkpoints, and bytes counted or scanned at once.
EVERY, STEP = 4096, 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _starts(data: np.ndarray, a: int, b: int, unit: str) -> np.ndarray:
    """Which of the bytes a .. b-1 start a unit: a code point, a line with its end, or a word with the spaces after it
    (spaces before the first word are a unit of their own)."""
    if unit == "code_points":
        return (data[a:b] & 0xC0) != 0x80
    out = np.empty(b - a, dtype=bool)
    out[0] = True
    if unit == "lines":
        out[1:] = data[a : b - 1] == 0x0A
        if a:
            out[0] = data[a - 1] == 0x0A
    elif unit == "words":
        space = _SPACE[data[a:b]]
        out[1:] = ~space[1:] & space[:-1]
        if a:
            out[0] = not space[0] and _SPACE[data[a - 1]]
    else:
        raise ValueError(f"no such unit: {unit}")
    return out


class Checkpoints:
    """The number of units of a text, and where every EVERY-th one starts, in bytes and in code points."""

    def __init__(self, text: bytes, unit: str = "code_points", every: int = EVERY, step: int = STEP):
        self.data, self.unit, self.every = np.frombuffer(text, np.uint8), unit, every
        self.n = self.points = 0
        units, at, chars = ([np.zeros(0, np.int64)] for _ in range(3))
        for a in range(0, len(text), step):
            b = min(len(text), a + step)
            starts = np.flatnonzero(_starts(self.data, a, b, unit))
            points = starts if unit == "code_points" else np.flatnonzero(_starts(self.data, a, b, "code_points"))
            ahead = -self.n % every
            marked = starts[ahead::every]
            units.append(self.n + ahead + every * np.arange(len(marked)))
            at.append(a + marked)
            chars.append(self.points + np.searchsorted(points, marked))
            self.n += len(starts)
            self.points += len(points)
        self.units, self.bytes, self.chars = map(np.concatenate, (units, at, chars))

    def cut(self, u: int) -> tuple[int, int]:
        """Byte and code-point offset at which unit u starts; the text's end for u = n."""
        if u >= self.n:
            return len(self.data), self.points
        i = int(np.searchsorted(self.units, u, side="right")) - 1
        a, chars, left = int(self.bytes[i]), int(self.chars[i]), u - int(self.units[i])
        while True:  # a rescan of fewer than EVERY units, the checkpoint's own the first
            b = min(len(self.data), a + 4 * self.every)
            starts = np.flatnonzero(_starts(self.data, a, b, self.unit))
            stop = a + int(starts[left]) if left < len(starts) else b
            chars += int(np.count_nonzero((self.data[a:stop] & 0xC0) != 0x80))
            if left < len(starts):
                return stop, chars
            left -= len(starts)
            a = b


_CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _rearranged(unit: str, cut_percent: int, spm_percent: int, every: int):
    marks = [m.encode() for m in MARKS]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.parts(batches):
            rows = []
            for text, h1, h2, h3, h4 in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4"))):
                index = Checkpoints(text, unit, every)
                n = index.n
                if not text or h3 % 100 >= cut_percent or any(x in text for x in marks):
                    rows.append((n, "plain", None, None, text))
                    continue
                (a, a_chars), (b, b_chars) = (index.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                pre, mid, suf = text[:a], text[a:b], text[b:]
                spm = h4 % 100 < spm_percent
                rows.append((n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join((s, suf, p, pre, m, mid) if spm else (p, pre, s, suf, m, mid))))
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def transform(docs: DataFrame, unit: str = "code_points", seed: str = "1", cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, every: int = EVERY) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    The cuts and the form come from four numbers: the first 8-digit groups of the SHA-256 of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    rows = frames.documents(docs, digest.alias("_h")).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *map(number, range(4)))
    return rows.mapInArrow(_rearranged(unit, cut_percent, spm_percent, every), _CUT)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The exact text, rebuilt from an output and its form alone."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = MARKS
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    psm = F.concat(between(p, s), F.substring_index(output, m, -1), between(s, m))
    spm = F.concat(between(p, m), F.substring_index(output, m, -1), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cut: DataFrame) -> DataFrame:
    """Of transform()'s rows: the counts, the form, and the hashes of the output and of the text rebuilt from it."""
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def oracle() -> str:
    """digests(transform(documents)) in DuckDB's SQL."""
    p, s, m = MARKS
    return f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
f as (select *, case when n = 0 or contains(t, '{p}') or contains(t, '{s}') or contains(t, '{m}') or h3 % 100 >= {CUT_PERCENT} then 'plain' when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form,
             least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from k),
c as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '{p}' || pre || '{s}' || suf || '{m}' || mid else '{s}' || suf || '{p}' || pre || '{m}' || mid end) as output_sha256, sha256(t) as restored_sha256
from c
"""
