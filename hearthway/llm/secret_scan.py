"""Secrets in texts: patterns, and encoded keys and tokens that are confirmed by their structure.

Spans of the kinds `assign`, `access` and `hex` come from patterns alone. Candidates in base64 or
hexadecimal digits are decoded and reported only if what they hold is whole: a private key in DER whose
nested lengths fill each other exactly, an OpenSSH private key with its length-prefixed fields, or a
signed token with a JSON header that names an algorithm. Keys may stand in PEM marks with real or escaped line ends, or
as base64 wrapped over lines; a key joined to text before it by `/`, `-`, `_` or `+`, or hexadecimal digits with an odd one at an end, are tried
where such a key can begin.

Null text counts as empty and has no spans. Whole texts are scanned, whatever their length. Rows
with null ids and repeated rows are scanned like others. Empty tables give empty results. Places count
code points, ends are exclusive. Other columns are ignored by `scan_secrets` and kept by `redact`.
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
from pyspark.sql import types as T

from hearthway.llm.shared import as_texts, trimmed

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token", "hexkey")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are maximal, so a least length in the pattern finds the same spans as a test afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([^-]*)-----END \1PRIVATE KEY-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
TOKEN = re.compile(r"ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: How a key begins in base64: the sequence of DER, or the OpenSSH magic.
BEGIN = r"(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)"
#: A key that is glued to something in front of it.
GLUED = re.compile(rf"(?<=[-_+/]){BEGIN}")
#: A key in base64 over several lines, with real or escaped line ends, the first line full.
LINE_END = re.compile(r"\r?\n|\\r\\n|\\n")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{{60,80}}[\r\n\\]){BEGIN}[A-Za-z0-9+/]+(?:(?:\r?\n|\\r\\n|\\n)[A-Za-z0-9+/]+={{0,2}})+")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{80,}")
SSH_MAGIC = b"openssh-key-v1\x00"


def from_base64(text: str) -> bytes | None:
    """Decode either alphabet, padded or not; None if it is no base64."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER values that fill `data` exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            count = size & 0x7F
            if not 0 < count <= 4 or at + count > len(data):
                return None
            size = int.from_bytes(data[at : at + count], "big")
            if size < 0x80 or data[at] == 0:
                return None
            at += count
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8 private key in DER."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [tag for tag, _ in inner]
    if tags[:3] == [0x02, 0x30, 0x04] and inner[0][1] in (b"\x00", b"\x01"):
        return _names_algorithm(inner[1][1])
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:
        return _names_algorithm(inner[0][1])
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\x01" and len(inner[1][1]) >= 16:
        return all(der_items(body) is not None for tag, body in inner[2:] if tag in (0xA0, 0xA1))
    return len(tags) >= 6 and set(tags[:6]) == {0x02} and inner[0][1] in (b"\x00", b"\x01")


def _names_algorithm(body: bytes) -> bool:
    parts = der_items(body)
    return bool(parts) and parts[0][0] == 0x06 and len(parts[0][1]) >= 3


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: its magic, names, key count and fields, all of them whole."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if field() is None or field() is None or field() is None:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 0 < keys < 100:
        return False
    for _ in range(keys):
        public = field()
        if public is None or not 0 < int.from_bytes(public[:4], "big") <= len(public) - 4:
            return False
    return bool(field())


def is_signed_token(text: str) -> bool:
    """Whether header and claims are JSON objects, the header names an algorithm and a signature follows."""
    header, claims, signature = text.split(".")
    try:
        head, body = (json.loads(from_base64(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"].lower() == "none" or len(from_base64(signature) or b"") >= 16


def der_chars(run: str) -> int:
    """How many characters of base64, but for padding, the DER value has that begins here; 0 if none does."""
    head = from_base64(run[:8]) if len(run) >= 8 else None
    if not head or head[0] != 0x30:
        return 0
    count = head[1] & 0x7F if head[1] & 0x80 else 0
    if count > 4:
        return 0
    size = int.from_bytes(head[2 : 2 + count], "big") if count else head[1]
    return ((2 + count + size) * 4 + 2) // 3


def key_kind(run: str) -> str | None:
    """The kind of the key that a base64 run holds, if it does. Only runs as long as their first bytes say are decoded."""
    bare = run.rstrip("=")
    if der_chars(bare) == len(bare):
        return "der" if is_private_key(from_base64(run) or b"") else None
    return "openssh" if bare.startswith("b3Blbn") and is_openssh_key(from_base64(run) or b"") else None


def glued_key(run: str) -> tuple[int, str] | None:
    """Where a key begins that ends with the run, and its kind. Of several OpenSSH magics the last is tried."""
    size = len(run.rstrip("="))
    magics = [m.start() for m in GLUED.finditer(run) if run.startswith("b3", m.start())][-1:]
    for at in [*(m.start() for m in GLUED.finditer(run) if run[m.start()] == "M"), *magics]:
        if (at in magics or der_chars(run[at : at + 8]) == size - at) and (kind := key_kind(run[at:])):
            return at, kind
    return None


def wrapped_key(block: str) -> tuple[int, str] | None:
    """Where the key stops that a block of base64 lines begins with, and its kind. It ends with a line."""
    need = der_chars(block)
    bare = stop = 0
    for line in re.finditer(r"([A-Za-z0-9+/]+)={0,2}", LINE_END.sub(lambda m: " " * len(m[0]), block)):
        bare, stop = bare + len(line[1]), line.end()
        if need and bare >= need:
            break
    kind = key_kind(LINE_END.sub("", block[:stop])) if stop else None
    return (stop, kind) if kind else None


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then by kind as listed."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            body = "".join(x for x in LINE_END.split(m[2]) if ":" not in x)
            data = from_base64("".join(body.split()))
            # The body of an encrypted key of the old form has no structure; its headers have.
            if data and (is_private_key(data) or is_openssh_key(data) or "ENCRYPTED" in m[2] and "DEK-Info:" in m[2]):
                found.append((m.start(), m.end(), "pem"))
    for m in BASE64.finditer(text):
        if kind := key_kind(m[0]):
            found.append((m.start(), m.end(), kind))
        elif glued := glued_key(m[0]):
            found.append((m.start() + glued[0], m.end(), glued[1]))
    marked = [(start, end) for start, end, kind in found if kind == "pem"]
    for m in WRAPPED.finditer(text):
        if (key := wrapped_key(m[0])) and not any(start < m.start() < end for start, end in marked):
            found.append((m.start(), m.start() + key[0], key[1]))
    if "ey" in text:
        found += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    for m in LONG_HEX.finditer(text):
        # With an odd number of digits one at either end is not the key's.
        for low, high in [(0, len(m[0]))] if len(m[0]) % 2 == 0 else [(0, len(m[0]) - 1), (1, len(m[0]))]:
            if m[0].startswith("30", low) and is_private_key(bytes.fromhex(m[0][low:high])):
                found.append((m.start() + low, m.start() + high, "hexkey"))
                break
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, counts of the base kinds, digest of the base spans, all spans as text."""
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    names = [id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    schema = T.StructType([T.StructField(id_col, narrow.schema[0].dataType)])
    for kind in BASE:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find_secrets(x) for x in as_texts(batch.column(1))]
            counts = [pa.array([sum(k == kind for *_, k in x) for x in spans], pa.int64()) for kind in BASE]
            digest = [hashlib.sha256(listed([y for y in x if y[2] in BASE]).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([listed(x) for x in spans], pa.string())], names=names)

    return narrow.mapInArrow(scan, schema)


def redacted(text: str) -> str:
    """The text with each secret, or run of overlapping ones, replaced by the kind of the first."""
    out, at, end = [], 0, -1
    for start, stop, kind in find_secrets(text):
        if start >= end:
            out += [text[at:start], f"[{kind}]"]
            end = stop
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with secrets taken out of the texts and the size column, if there, brought up to date."""
    place = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else redacted(x) for x in batch.column(place).to_pylist()]
            arrays = [*batch.columns]
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    out = docs.mapInArrow(trimmed(scan), docs.schema)
    if size_col in docs.columns:
        changed = F.length(text_col).cast(docs.schema[size_col].dataType)
        out = out.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(changed))
    return out
