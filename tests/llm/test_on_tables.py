"""The registered queries on the smallest shared tables, against brute force and the contracts."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm._common import read_table
from lodestone.llm.queries import QUERIES
from test_near_dup import brute as near_dup_brute
from test_repeats import brute as repeats_brute
from test_secrets import plain as plain_secrets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]


def run(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def test_token_output(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np
    import public_tokenizers

    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = run(spark, "op1_token_output"), 0
    for d, t in sorted(docs):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        assert tuple(got[d])[:4] == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_winnowing(spark, docs):
    got, order = run(spark, "op2_winnowing"), sorted(docs, reverse=True)
    for i, (d, t) in enumerate(order):
        nxt, t = order[(i + 1) % len(order)][1] or "", t or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)
    prints = {}
    for d, t in docs:
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_suffix_dedup(spark, docs):
    got = run(spark, "op3_suffix_dedup")
    want = repeats_brute([t or "" for _, t in docs], lambda t: t.encode(), bytes, 400)
    assert all(tuple(got[d])[1:5] == w for (d, _), w in zip(docs, want, strict=True))


def test_near_dup(spark, docs):
    got = Counter(tuple(r)[:4] for r in run(spark, "op5_minhash_near_dup").values())
    assert got == Counter(near_dup_brute(docs, 3, 85))


def test_secrets(spark, docs):
    got = run(spark, "op7_secrets")
    for d, t in docs:
        spans = plain_secrets(t or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


def test_decontamination(spark, docs):
    items = {r.item_id: r.text for r in read_table(spark, SF, "benchmark").collect()}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    exact = {(d, i) for d, t in docs for i, p in items.items() if t and p in t}
    assert exact and exact <= found


def test_substring_dedup(spark, docs):
    got = run(spark, "op10_substring_dedup")
    want = repeats_brute([t or "" for _, t in docs], WORD.findall, lambda ws: " ".join(ws).encode(), 35)
    assert all(tuple(got[d])[1:4] == (w[0], w[1], w[3]) for (d, _), w in zip(docs, want, strict=True))


def test_mixing_and_scores(spark, docs):
    got = run(spark, "op6_mixing")
    assert all(got[d]["size"] == len(WORD.findall(t or "")) and got[d].taken <= 2 * got[d]["size"] for d, t in docs)
    for name in ("op4_language_id", "op9_toxicity"):
        rows = run(spark, name)
        assert set(rows) == {d for d, _ in docs} and all(0 <= r.score <= 1 for r in rows.values())
