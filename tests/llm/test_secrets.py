"""Secret scan: base kinds against the plain patterns, confirmation of real and false structures."""

import base64
import hashlib
import json
import random
import re

import lodestone.llm.secrets as m


def plain(text):
    """The base kinds as they are stated: match, then drop."""
    spans = []
    for x in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.IGNORECASE | re.ASCII):
        if len(x[2]) >= 6:
            spans.append((x.start(), 0, x.end()))
    spans += [(x.start(), 1, x.end()) for x in re.finditer("AKIA[A-Z0-9]+", text) if len(x[0]) >= 20]
    spans += [(x.start(), 2, x.end()) for x in re.finditer("[0-9a-f]+", text) if len(x[0]) >= 24]
    return sorted(spans)


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode().rstrip("=" if url else "")


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + head + body


KEY = der(0x30, der(2, b"\0") + der(2, b"\x7f" * 128) + der(2, b"\1\0\1"))
JWT = f"{b64(json.dumps({'alg': 'HS256'}).encode(), True)}.{b64(json.dumps({'sub': 1}).encode(), True)}.{'x' * 43}"
field = lambda b: len(b).to_bytes(4) + b
SSH = field(b"ssh-ed25519") + field(b"k" * 32)


def test_base_kinds():
    r = random.Random(1)
    pieces = ["password", "Passwd=", "SECRET : ", "api_key", "ApIkEy='", "token\"= \"", "AKIA", "ABCDEFGHIJKLMNOPQRST", "deadbeef" * 3, "0", " ", "é", "toKen:", "abc", "=x.y-", "\U0001f511", "ſecret=abcdefgh", "toKen=abcdefgh", "AKIAAKIA"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert [s for s in m.find(text) if s[1] < 3] == plain(text), text


def test_confirmed():
    kinds = lambda t: [m.KINDS[k] for _, k, _ in m.find(t) if k > 2]
    assert kinds(f"see {JWT} here") == ["jwt"]
    assert kinds(f"key {b64(KEY)} end") == ["der"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{b64(KEY)}\n-----END RSA PRIVATE KEY-----") == ["der"]
    assert kinds(f"ssh-ed25519 {b64(SSH)} me@x") == ["ssh"]
    assert "der" in kinds(KEY.hex()) and m.is_der_key(KEY)
    # One byte off, a header that is no object, a length that doesn't fit: nothing.
    assert kinds(b64(KEY[:-1])) == [] and kinds(b64(KEY + b"\0")) == []
    assert kinds(f"{b64(b'{[]}', True)}.{b64(b'{}', True)}.abc") == [] and kinds(b64(SSH[:-1])) == []
    assert kinds("A" * 80) == [] and kinds("MII" + "x" * 100) == []


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, f"token={'a' * 30} {JWT}", "x"), (2, "", "x"), (4, "é" * 9 + "AKIA" + "A" * 16, "x")]
    got = {(r.doc_id, r.spans): r for r in m.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert got[(1, "")].base_sha256 == hashlib.sha256(b"").hexdigest() and (2, "") in got and (4, "access:9:29") in got
    odd = next(r for (d, _), r in got.items() if d is None)
    assert odd.spans.startswith("assign:0:36,hex:6:36,jwt:37:") and (odd.n_assign, odd.n_access, odd.n_hex, odd.n_confirmed) == (1, 0, 1, 1)
    assert odd.base_sha256 == hashlib.sha256(b"assign:0:36,hex:6:36").hexdigest()
    assert m.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
