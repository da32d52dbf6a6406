"""Operator 8, secret scan with structural confirmation.

Base patterns give candidate spans. Encoded candidates (base64, hex, PEM blocks, signed tokens) are
decoded and reported only if what they hold parses: key encodings by their nested lengths, tokens by
their header. One pass without a shuffle; a text is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract: patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "nested")

#: A JSON object's first byte in base64 is ``e`` and one of ``w`` to ``z``.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[w-z][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: The shortest base span has 14 bytes (``token`` or an equally short name, a sign and 8 characters):
#: 19 base64 characters, 28 hex digits.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{19,}|[A-Za-z0-9_-]{19,})={0,2}")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{28,}")
#: Line ends and slashes of a PEM body as JSON, env strings and shells write them.
ESCAPED_END, ESCAPED_SLASH = re.compile(r"\\+[nrt]|\\+[\x20\t\r]*(?=\n|\Z)|\r"), re.compile(r"\\+/")
#: Decodings within decodings that are followed.
DEPTH = 2


def decode64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 with or without padding, or None."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive DER items that fill ``data`` exactly, or None."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n = int.from_bytes(data[i : i + k], "big")
            i += k
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key by its nested lengths: RSA (PKCS #1), EC (SEC 1), PKCS #8 or encrypted PKCS #8."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if len(inner) >= 9 and tags[:9] == [2] * 9 and len(inner[1][1]) >= 32:
        return True
    if tags[:2] == [2, 4] and inner[0][1] == b"\x01" and len(inner[1][1]) >= 16:
        return True
    if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\x00", b"\x01"):
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 6
    if tags == [0x30, 4]:
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 6 and len(inner[1][1]) >= 16
    return False


def is_openssh_key(data: bytes) -> bool:
    """The open key format: magic, then three length-prefixed strings, a count and the keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    i = len(magic)
    for _ in range(3):
        if i + 4 > len(data):
            return False
        i += 4 + int.from_bytes(data[i : i + 4], "big")
    return i + 4 <= len(data) and int.from_bytes(data[i : i + 4], "big") >= 1


def is_signed_token(text: str) -> bool:
    """A header that is a JSON object with an algorithm, and a payload that is a JSON object."""
    head, payload, _ = text.split(".", 2)
    try:
        header = json.loads(decode64(head) or b"")
        return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(json.loads(decode64(payload) or b""), dict)
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, end exclusive, in code points."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the encoded candidates whose content parses."""
    out = [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m.group())]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            stop = text.find("-----", m.end())
            tail = f"-----END {m.group(1)}-----"
            if stop >= 0 and text.startswith(tail, stop):
                body = ESCAPED_SLASH.sub("/", ESCAPED_END.sub("\n", text[m.end() : stop]))
                lines = [x for x in body.split("\n") if ":" not in x]  # header lines
                data = decode64("".join("".join(lines).split()))
                if data and (is_der_key(data) or is_openssh_key(data) or "ENCRYPTED" in text[m.end() : m.end() + 60]):
                    out.append((m.start(), stop + len(tail), "pem"))
    for pattern in (BASE64, LONG_HEX):
        for m in pattern.finditer(text):
            data = decode64(m.group()) if pattern is BASE64 else bytes.fromhex(m.group()[: len(m.group()) // 2 * 2])
            if not data:
                continue
            if is_der_key(data) or is_openssh_key(data):
                out.append((m.start(), m.end(), "der"))
            elif depth > 0:
                try:
                    inner = data.decode()
                except UnicodeDecodeError:
                    continue
                if base_spans(inner) or confirmed_spans(inner, depth - 1):
                    out.append((m.start(), m.end(), "nested"))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted({(a, KINDS.index(k), b, k) for a, b, k in spans}))


SPANS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_assign, n_access, n_hex, base_sha256 and spans
    (``kind:start:end``, by start, then kind, comma-joined).

    A null or empty text has no spans. Null ids and repeated rows stay; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), common.byte_column(part, "text"), strict=True):
                    text = raw.decode("utf-8", "replace") if raw else ""
                    base = base_spans(text)
                    kinds = [k for _, _, k in base]
                    rows.append((doc, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + confirmed_spans(text))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SPANS, strict=True)], schema=SPANS)

    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("doc_id", id_col)
