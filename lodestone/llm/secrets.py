"""Secret scan with structural confirmation.

Base kinds are found by pattern. Beyond them, every run of base64 or hex characters that could hold a key is decoded,
and reported only if what comes out has the structure of one: a signed token's header, nested DER lengths that
add up, or the length-prefixed fields of an SSH key.

Kinds, in this order: assign, access, hex (base); jwt (three base64url parts, the first two JSON objects, the first with ``alg``),
der (PEM body or bare base64 or hex whose DER elements fill their lengths exactly, with an integer or key
identifier inside), ssh (``ssh-...`` or ``ecdsa-...`` blob, or ``openssh-key-v1``, with fields that fit).

Spans are code points, end exclusive. The span of an assign is the whole match. Base spans never change.

Defined cases: null and empty texts have no spans (empty strings, the sha256 of nothing, zeros). Repeated or null
doc_ids keep their rows; an empty table gives no rows; other columns are ignored.
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

from lodestone.llm._common import small_batches, tidy

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile(f"({_either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: With the least length inside the pattern; a run is taken whole either way, and its tail can't be longer.
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
#: Words of which an assign has one.
KEYS = ("passw", "secret", "token", "api")


def _der(data: bytes, depth: int = 0) -> tuple[int, set[int]] | None:
    """Length and tags of the DER element at the start of ``data``, if all nested lengths fit."""
    if len(data) < 2 or depth > 12:
        return None
    tag, size, at = data[0], data[1], 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(data) < 2 + n or data[2] == 0:
            return None
        size, at = int.from_bytes(data[2 : 2 + n]), 2 + n
        if size < 128:
            return None
    if at + size > len(data) or tag & 0x1F == 0x1F:
        return None
    tags = {tag}
    if tag & 0x20:
        end = at + size
        while at < end:
            if (inner := _der(data[at:end], depth + 1)) is None:
                return None
            tags |= inner[1]
            at += inner[0]
        return end, tags
    return at + size, tags


def is_der_key(data: bytes) -> bool:
    """A DER sequence over the whole of ``data`` that holds an integer, or an identifier beside a string of bits or bytes."""
    if len(data) < 20 or data[0] != 0x30 or (found := _der(data)) is None or found[0] != len(data):
        return False
    return 0x02 in found[1] or (0x06 in found[1] and bool(found[1] & {0x03, 0x04}))


def is_ssh_key(data: bytes) -> bool:
    """The fields of an SSH key: each a length and as many bytes, to the end."""
    private = data.startswith(b"openssh-key-v1\0")
    at = 15 if private else 0
    if not private and not re.match(rb"\0\0\0.(ssh-|ecdsa-|sk-)", data, re.DOTALL):
        return False
    fields = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4])
        if private and fields == 3:  # the number of keys
            at, fields = at + 4, fields + 1
            continue
        if at + 4 + size > len(data):
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 2 and at == len(data)


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, claims: str) -> bool:
    """Both parts are JSON objects, and the header names an algorithm."""
    for part, needs in ((header, "alg"), (claims, None)):
        try:
            found = json.loads(_decoded(part, url=True) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(found, dict) or needs and not isinstance(found.get(needs), str):
            return False
    return True


def find(text: str) -> list[tuple[int, int, int]]:
    """All spans (start, kind's number, end), sorted."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        spans += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    pem = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = _decoded(m[2])
            if body is not None and (is_der_key(body) or is_ssh_key(body)):
                spans.append((m.start(), 4 if is_der_key(body) else 5, m.end()))
                pem.append((m.start(), m.end()))
    for m in BASE64.finditer(text):
        if not any(a <= m.start() < b for a, b in pem) and m[0][:2] in _STARTS and (body := _decoded(m[0])) is not None:
            if is_der_key(body):
                spans.append((m.start(), 4, m.end()))
            elif is_ssh_key(body):
                spans.append((m.start(), 5, m.end()))
    for m in HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            spans.append((m.start(), 4, m.end()))
    return sorted(set(spans))


#: How base64 of a DER sequence (0x30 with a length), of three zero bytes, and of "openssh-key-v1" begins.
_STARTS = {base64.b64encode(bytes([0x30, x, 0]))[:2].decode() for x in range(256)} | {"AA", "b3"}


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t) if t else [] for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(3)]
        base = [hashlib.sha256(_joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
        confirmed = pa.array([sum(k > 2 for _, k, _ in s) for s in found], pa.int64())
        columns = [batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([_joined(s) for s in found], pa.string()), confirmed]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed of every row."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(tidy(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
