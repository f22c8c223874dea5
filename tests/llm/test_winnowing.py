"""Winnowing against a plain version; match guarantee; the next document over ranges; long and unspaced texts; no Python in the plan."""

import hashlib
import random
import re

import pytest
import xxhash

from lodestone.llm import winnowing as m

SCHEMA = "doc_id long, text string, next string, range string, n_chars int"


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé\U0001f600") for _ in range(r.randint(1, 3)))
    texts = [None, "", " \n", "one", "a b", "ü" * 9] + [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(n)]
    ids = list(range(0, 3 * len(texts), 3))
    r.shuffle(ids)
    return [(i, t) for i, t in zip(ids, texts, strict=True)] + [(None, "null id"), (ids[5], "zz repeated id"), (ids[5], "zz repeated id")]


def test_edited(spark, monkeypatch):
    monkeypatch.setattr(m, "RANGE", 7)
    rows = corpus(1, 90)
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], SCHEMA).repartition(5)
    got = m.edited_likeness(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = []
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((g.doc_id, g.n_chars, g.edited_sha256) for g in got), key=key) == sorted(want, key=key)
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)


@pytest.mark.parametrize("n", [1, 2])
def test_few(spark, n):
    rows = [(5, "a b c d e f g h"), (3, "a b c d e f g h")][:n]
    got = m.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == n and all(g.near_next == 1.0 for g in got)


def value(gram):
    """Upper 32 bits of the sum modulo 2 of the characters' hashes, the earlier shifted further."""
    total = 0
    for at, c in enumerate(reversed(gram)):
        total ^= (xxhash.xxh64_intdigest(c.encode(), 42) << at) & (1 << 64) - 1
    total >>= 32
    return total - (1 << 32) if total >> 31 else total


def brute(text, k, window):
    """(position, hash) chosen by looking at every window in turn."""
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        at = min(range(i, min(i + window, len(grams))), key=lambda p: (value(grams[p]), -p))
        if not out or out[-1][0] != at:
            out.append((at, value(grams[at])))
    return out


def chosen(spark, texts, k, window):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = m.F.col("chosen")
    return [r for r in m.fingerprints(docs, k, window).select("doc_id", "text", m.positions(f).alias("at"), m.F.transform(f, lambda x: m.F.shiftright(x, 32)).alias("h"), m.shown(f).alias("s")).orderBy("doc_id").collect()]


def test_choice(spark):
    r = random.Random(3)
    texts = [t or "" for _, t in corpus(2, 25)] + ["a" * 50, "ab" * 40, "日本語" * 20] + ["".join(r.choice("ab") for _ in range(80)) for _ in range(20)]
    for k, window in ((2, 4), (6, 1), (10, 7), (16, 32)):
        for row in chosen(spark, texts, k, window):
            if len(row.text) >= k:
                assert list(zip(row.at, row.h, strict=True)) == brute(row.text, k, window)
            else:
                assert row.at == [0] * bool(row.text)
            assert row.s == ",".join(f"{h & 0xFFFFFFFF:08x}@{p}" for p, h in zip(row.at, row.h, strict=True))


def test_edited_is_the_direct_one(spark):
    """Put together from the sources' fingerprints, or taken of the edited text: the same."""
    r = random.Random(6)
    sizes = [0, 1, 5, 15, 16, 47, 79, 80, 158, 159, 160, 161, 200, 319, 320, 321, 322, 400, 640, 700] * 4
    r.shuffle(sizes)
    texts = ["".join(r.choice(("ab", "abcdefgé日 ", "a")[i % 3]) for _ in range(n)) for i, n in enumerate(sizes)]
    for k, window in ((16, 32), (4, 3)):
        got = {g.doc_id: g for g in m.edited_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, window).collect()}
        edited = [t[: len(t) - len(t) // 2] + texts[i - 1][: len(t) // 2] for i, t in enumerate(texts)]
        want = chosen(spark, edited, k, window)
        own = chosen(spark, texts, k, window)
        jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        for i in range(len(texts)):
            assert got[i].edited_fingerprint == want[i].s and got[i].fingerprint == own[i].s
            assert got[i].near_edited == jaccard(own[i].h, want[i].h) and got[i].near_next == jaccard(own[i].h, own[i - 1].h)


def test_ties_go_right(spark):
    assert chosen(spark, ["a" * 12], 4, 4)[0].at == list(range(3, 9))


def test_guarantee(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh日é ") for _ in range(n))
    for k, window in ((4, 9), (16, 32)):
        pairs = []
        for _ in range(60):
            shared = word(k + window - 1)
            pairs += [word(r.randint(0, 60)) + shared + word(r.randint(0, 60)) for _ in range(2)]
        rows = chosen(spark, pairs, k, window)
        assert all(set(x.h) & set(y.h) for x, y in zip(rows[::2], rows[1::2], strict=True))


def test_unspaced_and_long(spark):
    r = random.Random(5)
    unspaced = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(4000))
    long = "".join(r.choice("abcdefghij ") for _ in range(1_500_000))
    rows = {g.doc_id: g for g in m.edited_likeness(spark.createDataFrame([(3, unspaced), (2, long), (1, None)], "doc_id long, text string")).collect()}
    assert rows[3].near_edited > 0.25 and rows[2].n_chars == 1_500_000 and rows[1].fingerprint == "" and rows[2].near_edited > 0.4 and rows[1].near_next == 0.0


def test_empty_and_native(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert m.edited_likeness(none).collect() == []
    plan = m.edited_likeness(spark.range(5).selectExpr("id AS doc_id", "'a b c' AS text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
