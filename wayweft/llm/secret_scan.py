"""Secret scans with structural confirmation.

Three base kinds are found by their patterns alone: assign, access and hex. The further kinds are reported
only after a candidate has been decoded and parsed: a signed-token header (jwt), a DER key encoding whose
nested lengths all fit (der), or an OpenSSH private key whose length-prefixed fields fit (openssh). Public keys
are no secrets and are not reported. A candidate is a base64, base64url or hexadecimal run; a PEM body counts as one run over
its lines, and so do base64 lines of one width, at least 20, with a shorter or equal last one. A line may
end in a literal backslash-n.

Spans are code points, end exclusive; spans of one kind do not overlap, those of different kinds may.

Hexadecimal keys are recognised as one run of whole bytes: of odd length, or parted by colons or spaces, they are
not decoded (their parts of 16 and more lower-case digits are base spans all the same).

Results: one row per row of the table. A null text counts as empty and has no span; null and repeated ids and
repeated texts are ordinary rows; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh")
BASE = KINDS[:3]
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # as AKIA[A-Z0-9]+ of 18 or more: the run is the same
_HEX = re.compile(r"[0-9a-f]{16,}")  # likewise
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?!\.?[A-Za-z0-9_-])")  # { is the first byte
_BREAK = r"(?:\s|\\+[rn])"  # a literal backslash-n, too, as in JSON and environment strings
_HEADERS = r"(?:[A-Za-z-]+: [^\n]*\n)*|(?:[A-Za-z-]+: (?:[^\n\\]|\\+(?![\\rn]))*(?:\\+[rn])+)*"
_PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]+)-----{_BREAK}*({_HEADERS})((?:[A-Za-z0-9+/=\s]|\\+[rn])+?)-----END \1-----")
_START = r"(?:(?<=\\[rn])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[rn]))"  # the n of a literal backslash-n is no base64
_BASE64 = re.compile(_START + r"[A-Za-z0-9+/_-]{40,}={0,2}")
_WRAPPED = re.compile(_START + r"[A-Za-z0-9+/_-]{20,}(?:(?:[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*)[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

#: Object identifiers of key algorithms in DER: RSA, EC, X25519, X448, Ed25519, Ed448, DSA, Diffie-Hellman.
_KEY_OIDS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571", "2a8648ce380401", "2a864886f70d010301")}
#: First fields of an SSH public key blob.
_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")

#: First bytes of the two kinds of keys.
_OPENINGS = (b"\x30", b"openssh-key-v1\0")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def decode(run: str) -> bytes | None:
    """Base64 or base64url, padded or not."""
    body = re.sub(r"\s+|\\+[rn]", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly; None if a length does not fit."""
    end, out = len(data) if end is None else end, []
    while start < end:
        if start + 2 > end:
            return None
        tag, size = data[start], data[start + 1]
        start += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end or data[start] == 0:
                return None
            size = int.from_bytes(data[start : start + n], "big")
            if size < 0x80:
                return None
            start += n
        if start + size > end:
            return None
        out.append((tag, start, start + size))
        start += size
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1 and SEC 1 private keys and PKCS#8 private keys (encrypted ones too)."""
    top = der_fields(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    fields = der_fields(data, *top[0][1:])
    if not fields:
        return False
    tags = [t for t, _, _ in fields]
    value = lambda i: data[fields[i][1] : fields[i][2]]
    if tags == [2] * 9:  # RSA: a version and eight numbers
        return sum(b - a for _, a, b in fields) >= 32
    if tags[:2] == [2, 4] and value(0) == b"\x01" and len(value(1)) in (20, 24, 28, 32, 48, 66):  # EC private key
        return True
    at = 1 if tags[:1] == [2] else 0  # PKCS#8 has a version first, its encrypted form has not
    if tags[at : at + 1] != [0x30]:
        return False
    inner = der_fields(data, *fields[at][1:])
    if not inner or inner[0][0] != 6:
        return False
    oid = data[inner[0][1] : inner[0][2]]
    if at == 1:
        return oid in _KEY_OIDS and tags[2:3] == [4]
    return tags[1:] == [4] and oid.startswith(bytes.fromhex("2a864886f70d01050d"))  # encrypted, PBES2


def ssh_fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out


def is_ssh_blob(data: bytes) -> bool:
    fields = ssh_fields(data)
    return bool(fields) and len(fields) > 1 and fields[0] in _SSH_NAMES


def is_openssh_private(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    rest, at = data[len(magic) :], 0
    for _ in range(3):  # cipher, derivation, options
        size = int.from_bytes(rest[at : at + 4], "big")
        if at + 4 + size > len(rest):
            return False
        at += 4 + size
    n = int.from_bytes(rest[at : at + 4], "big")
    fields = ssh_fields(rest[at + 4 :])
    return bool(fields) and len(fields) == n + 1 and all(is_ssh_blob(x) for x in fields[:-1])


def is_signed_token(header: str, payload: str) -> bool:
    """A header that is a JSON object with an algorithm, and a payload, of whatever content, that decodes."""
    try:
        one = json.loads(decode(header) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(one, dict) and isinstance(one.get("alg"), str) and decode(payload) is not None


def _kind_of(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "openssh" if is_openssh_private(data) else None


def _key_sizes(data: bytes) -> set[int]:
    """The lengths at which a key that begins data may end."""
    if data[:1] == b"\x30" and len(data) > 6:
        n = data[1] & 0x7F if data[1] & 0x80 else 0
        return {2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])} if n <= 4 else set()
    magic, at = b"openssh-key-v1\0", 0
    if data.startswith(magic):
        at = len(magic)
        for _ in range(3):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        at += 4
    else:
        return set()
    sizes = set()
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        sizes.add(at)
    return sizes


def _wrapped(text: str):
    """(kind, start, end) of the keys that fill several base64 lines."""
    for m in _WRAPPED.finditer(text):
        run = m[0]
        # the letter of a literal break is blanked, so that places stay
        lines = [x.span() for x in _LINE.finditer(re.sub(r"\\+[rn]", lambda b: " " * len(b[0]), run))]
        for i, (start, end) in enumerate(lines):
            width = end - start
            head = decode(run[start : start + 4 * min(16, width // 4)]) if width >= 20 else None
            if not head or not any(x[: len(head)] == head[: len(x)] for x in _OPENINGS):
                continue
            # DER tells its length, which bounds the lines
            most = min(len(lines), i + 2 + max(_key_sizes(head), default=0) * 4 // 3 // width) if head[:1] == b"\x30" else len(lines)
            last = i + 1
            while last < most and lines[last][1] - lines[last][0] == width:
                last += 1
            last += last < most and lines[last][1] - lines[last][0] < width
            body = "".join(run[a:b] for a, b in lines[i:last])
            whole = body.rstrip("=")
            sizes = _key_sizes(decode(whole[: len(whole) // 4 * 4]) or b"")
            size = 0
            for a, b in lines[i:last]:
                size += b - a
                if b > end and len(body[:size].rstrip("=")) * 3 // 4 in sizes and (kind := _kind_of(decode(body[:size]))):
                    yield kind, m.start() + start, m.start() + b


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind in the order of KINDS."""
    out = []
    if ":" in text or "=" in text:
        out += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    confirmed = []
    if "-----BEGIN " in text:
        confirmed += [(kind, *m.span()) for m in _PEM.finditer(text) if (kind := _kind_of(decode(m[3])))]
    if "." in text:
        confirmed += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    confirmed += [(kind, *m.span()) for m in _BASE64.finditer(text) if (kind := _kind_of(decode(m[0])))]
    confirmed += _wrapped(text)
    for m in _LONG_HEX.finditer(text):
        if kind := _kind_of(bytes.fromhex(m[0])):
            confirmed.append((kind, *m.span()))
    ends: dict[str, int] = {}
    for kind, start, end in sorted(confirmed, key=lambda x: (x[1], -x[2])):
        if start >= ends.get(kind, 0):
            ends[kind] = end
            out.append(Span(kind, start, end))
    return sorted(out, key=lambda x: (x.start, _ORDER[x.kind]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every stretch of overlapping spans replaced by the names of its kinds."""
    out, at, stretches = [], 0, []
    for x in spans:
        if stretches and x.start < stretches[-1][1]:
            last = stretches[-1]
            last[1] = max(last[1], x.end)
            if x.kind not in last[2]:
                last[2].append(x.kind)
        else:
            stretches.append([x.start, x.end, [x.kind]])
    for start, end, kinds in stretches:
        out += [text[at:start], f"[{'+'.join(kinds)}]"]
        at = end
    return "".join([*out, text[at:]])


_SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def _scan(batches):
    for batch in frames.parts(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            spans = find(text or "")
            base = [x for x in spans if x.kind in BASE]
            rows.append((*(sum(x.kind == k for x in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each document."""
    return frames.documents(docs).mapInArrow(_scan, _SCAN)


def _redact(batches):
    for batch in frames.parts(batches):
        at = batch.schema.get_field_index("text")
        texts = [t if not t else redact(t, find(t)) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced by their kinds in brackets; n_chars, if there, follows."""
    out = docs.mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
