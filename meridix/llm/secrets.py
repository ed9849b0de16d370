"""Secret scans: pattern spans, and key material confirmed by decoding and parsing its structure.

Base spans (``assign``, ``access``, ``hex``) come from patterns. The structural pass decodes base64 and hex candidates and
reports a span only if what they hold parses: DER private keys whose nested lengths add up, OpenSSH key blobs, PEM blocks
with such a body, and signed tokens whose header is a JSON object with an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
#: DER sequences start with byte 0x30, in base64 with M, in hex with 30; OpenSSH blobs with their magic.
DER64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-Za-z0-9+/]{39,}={0,2}")
DERHEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
SSH64 = re.compile(r"b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]{40,}={0,2}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
SSH_MAGIC = b"openssh-key-v1\0"


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[at:end] exactly, or None."""
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            length, at = int.from_bytes(data[at : at + size]), at + size
            if length < 0x80:
                return None
        if at + length > end:
            return None
        found.append((tag, at, at + length))
        at += length
    return found


def der_private_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key: PKCS#8 (plain or encrypted), PKCS#1, DSA or SEC 1, every nested length fitting."""
    whole = _elements(data, 0, len(data))
    if not whole or len(whole) != 1 or whole[0][0] != 0x30:
        return False
    parts = _elements(data, *whole[0][1:])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags[:3] == [0x02, 0x30, 0x04] and data[parts[0][1] : parts[0][2]] in (b"\0", b"\1"):
        inner = _elements(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and data[parts[0][1] : parts[0][2]] == b"\1":
        return parts[1][2] - parts[1][1] >= 16
    if tags == [0x30, 0x04]:
        inner = _elements(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == 0x06
    return len(tags) in (6, 9) and set(tags) == {0x02} and data[parts[0][1] : parts[0][2]] == b"\0"


def ssh_private_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: the magic, three length-prefixed strings, a key count, then public keys that fit."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
    if at + 4 > len(data):
        return False
    count, at = int.from_bytes(data[at : at + 4]), at + 4
    if not 1 <= count <= 16:
        return False
    for _ in range(count + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
        if at > len(data):
            return False
    return True


def _decode64(text: str) -> bytes:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _longest_der(data: bytes) -> int:
    """Bytes of a leading DER key in data, whose own length says where it ends; 0 if there is none."""
    if len(data) < 4 or data[0] != 0x30:
        return 0
    size = data[1] & 0x7F if data[1] >= 0x80 else 0
    length = 2 + size + (int.from_bytes(data[2 : 2 + size]) if size else data[1])
    return length if size <= 4 and length <= len(data) and der_private_key(data[:length]) else 0


def signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether three base64url parts are a signed token: JSON objects first and second, an algorithm in the header, a signature that decodes."""
    try:
        parts = [base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in (header, payload, signature)]
        head, body = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and (bool(parts[2]) or head["alg"] == "none")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, by start and then kind as listed."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded structure confirms a key or a signed token."""
    out = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            body = _decode64("".join(m[2].split()))
            if der_private_key(body) or ssh_private_key(body):
                out.append((m.start(), m.end(), "pem"))
    for m in DER64.finditer(text):
        data = _decode64(m[0].rstrip("=")[: len(m[0].rstrip("=")) // 4 * 4] if len(m[0].rstrip("=")) % 4 == 1 else m[0].rstrip("="))
        if n := _longest_der(data):
            out.append((m.start(), m.end() if n == len(data) else min(m.end(), m.start() + -(-n * 4 // 3)), "der"))
    for m in DERHEX.finditer(text):
        if n := _longest_der(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            out.append((m.start(), m.start() + 2 * n, "der"))
    if "b3BlbnNzaC1rZXktdjE" in text:
        out += [(m.start(), m.end(), "ssh") for m in SSH64.finditer(text) if ssh_private_key(_decode64(m[0].rstrip("=")))]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if signed_token(m[1], m[2], m[3])]
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of one text, by start and then kind; offsets are code points, the end exclusive. None counts as empty."""
    text = text or ""
    return sorted(base_spans(text) + structural_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, SHA-256 of the base spans, all spans, and on request the redacted text.

    Null and empty texts have no spans; a null id stays null; equal rows give equal rows; other columns are ignored."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = scan(text)
                base = [s for s in spans if s[2] in KINDS[:3]]
                kinds = [s[2] for s in base]
                rows.append((doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), redact(text or "", spans) if redacted else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out if redacted else out.drop("redacted")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; ``n_chars``, if there is one, counts the new text. Null texts stay null and empty ones empty; all rows, repeated ones too, and other columns, of any names, stay as they are; an empty table gives no rows."""
    at, kept = docs.columns.index("text"), docs.schema

    def run(batches):
        for batch in slices(batches):
            texts = [t if t is None else redact(t, scan(t)) for t in batch.column(at).to_pylist()]
            out = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in docs_names:
                k = docs_names.index("n_chars")
                out = out.set_column(k, "n_chars", pa.array([None if t is None else len(t) for t in texts], batch.schema.field(k).type))
            yield out

    docs_names = docs.columns
    return docs.mapInArrow(run, kept)
