"""Both substring operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from lodestone.llm.substring_dedup import remove_repeated_words
from lodestone.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, spans string, rid int, key string"


def brute(texts, split, join, window):
    seqs = [split(t) for t in texts]
    times = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if times[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        left = [x for x, g in zip(s, gone, strict=True) if not g]
        out.append((len(s), sum(gone), runs, hashlib.sha256(join(left)).hexdigest()))
    return out


def texts_for(seed, window, alphabet):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 3)))
    passage = [" ".join(word() for _ in range(window * 2)) for _ in range(4)]
    texts = [None, "", " ", "a" * (window * 3), "a" * window, "x", "\t".join("ab" for _ in range(window * 2))]
    for _ in range(alphabet):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passage)
            a = r.randint(0, len(p) - 1)
            parts += [p[a:] if r.random() < 0.5 else p[: a + 1], " ".join(word() for _ in range(r.randint(0, window)))]
        texts.append(r.choice((" ", "\n", "")).join(parts))
    return texts + texts[-5:] + [texts[-1]] * 30


@pytest.mark.parametrize(("window", "seed"), [(20, 1), (57, 2), (7, 3)])
def test_bytes(spark, window, seed):
    texts = texts_for(seed, window, 60)
    rows = [(i if i % 17 else None, t, "x", i, "k") for i, t in enumerate(texts)]
    got = remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5), window)
    want = brute([t or "" for t in texts], lambda t: list(t.encode()), bytes, window)
    assert Counter(map(tuple, got.collect())) == Counter((rows[i][0], *w) for i, w in enumerate(want))


@pytest.mark.parametrize(("window", "seed"), [(5, 4), (12, 5), (3, 6)])
def test_words(spark, window, seed):
    texts = texts_for(seed, window, 60)
    rows = [(i if i % 17 else None, t, "x", i, "k") for i, t in enumerate(texts)]
    got = remove_repeated_words(spark.createDataFrame(rows, SCHEMA).repartition(5), window)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    want = brute([t or "" for t in texts], split, lambda ws: " ".join(ws).encode(), window)
    assert Counter(map(tuple, got.collect())) == Counter((rows[i][0], w[0], w[1], w[3]) for i, w in enumerate(want))


def told_apart(units):
    """Units that come again, and the first of each different one whose key has several, with the number of these."""
    entry = lambda u: (u["key"], u["one"], u["two"])
    times = Counter(map(entry, units))
    variants = Counter(k for k, _, _ in times)
    first = {entry(u): u for u in reversed(units)}
    unsure = [u | {"single": u.get("single", True) and times[e] == 1, "variants": variants[u["key"]]} for e, u in first.items() if variants[u["key"]] > 1]
    return [u for u in units if times[entry(u)] > 1], unsure


def in_process(texts, method, split, group, buffer, most):
    """The stages run in this process, so that small limits hold: (symbols, symbols removed) of each text, and the kinds of rows met."""
    import numpy as np
    import pyarrow as pa

    import lodestone.llm._repeats as m

    ids = [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.string())]
    units = [r for b in m._emit_units(method)(iter([pa.RecordBatch.from_arrays(ids, ["rid", "rth", "text"])])) for r in b.to_pylist()]
    again, unsure = told_apart(units)
    todo = {}
    for u in unsure:
        todo.setdefault(u["rid"], []).append({k: u[k] for k in ("start", "n", "lead", "key", "single", "variants")})
    kinds, batches = set(), lambda rows, schema: iter([m._rows([tuple(r[f.name] for f in schema) for r in rows[i : i + 7]], schema) for i in range(0, len(rows), 7)])
    if todo:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("lead", pa.int32()), ("key", pa.int64()), ("single", pa.bool_()), ("variants", pa.int64())]))
        columns = [pa.array(list(todo)), pa.array([0] * len(todo)), pa.array([texts[i] for i in todo], pa.string()), pa.array(list(todo.values()), kind)]
        given = pa.RecordBatch.from_arrays(columns, ["rid", "rth", "text", "units"])
        rows = [r for b in m._emit_open(method, group)(iter([given])) for r in b.to_pylist()]
        kinds = {r["kind"] for r in rows}
        parts = [r for b in m._emit_parts(method)(batches([r for r in rows if r["kind"] == m.CROWDED], m._OPEN)) for r in b.to_pylist()]
        parts_again, unsure = told_apart(parts)
        again += [p for p in parts_again if p["single"]]
        unsure = [u | {"deal": u["key"], "kind": m.TEXT} for u in unsure]
        windows = m._emit_windows(method, most)(batches([u for u in unsure if u["variants"] > group], m._OPEN))
        rows = [r for r in rows if r["kind"] == m.TEXT] + [u for u in unsure if u["variants"] <= group] + [r for b in windows for r in b.to_pylist()]
        kinds |= {r["kind"] for r in rows}
        rows.sort(key=lambda r: r["deal"])
        again += [r for b in m._resolve(method, buffer)(batches(rows, m._OPEN)) for r in b.to_pylist()]
    spans = {}
    for r in again:
        spans.setdefault(r["rid"], []).append(r)
    sizes = [len(split(t or "")) for t in texts]
    return [(n, int(np.sum(m.covered(spans.get(i), n, method.window)))) for i, n in enumerate(sizes)], kinds


def test_methods_with_small_limits():
    """Crowded keys, cut long texts, small buffers and all densities of triggers and anchors."""
    assert set().union(*(small_limits(seed) for seed in range(24))) == {0, 1, 2, 3}


def small_limits(seed):
    from lodestone.llm.substring_dedup import RelativeLempelZiv
    from lodestone.llm.suffix_dedup import PrefixFreeParsing

    r, met = random.Random(seed), set()
    window = r.choice([5, 12, 33])
    texts = texts_for(seed, window, r.choice([5, 20, 60]))
    limits = (r.choice([1, 2, 4, 512]), r.choice([1, 10, 1 << 19]), r.choice([0, 3, 1 << 19]))
    cut = r.choice([64, 200, 1 << 18])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for method, split, join in (
        (PrefixFreeParsing(window, min(16, r.randint(1, window)), r.choice([2, 3, 24]), cut), lambda t: list(t.encode()), bytes),
        (RelativeLempelZiv(window, r.randint(1, window), cut), words, lambda ws: " ".join(ws).encode()),
    ):
        got, kinds = in_process(texts, method, split, *limits)
        assert got == [w[:2] for w in brute([t or "" for t in texts], split, join, window)]
        met |= kinds
    return met


@pytest.mark.parametrize("group", [1, 3])
def test_crowded_keys(spark, group):
    """A passage that many texts share, each with other words around it, also with one or two of these alike."""
    from lodestone.llm._repeats import covered, repeated_windows
    from lodestone.llm.substring_dedup import RelativeLempelZiv
    from lodestone.llm.suffix_dedup import PrefixFreeParsing

    r = random.Random(group)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    passage, near = [word() for _ in range(30)], [word() for _ in range(3)]
    texts = [" ".join([*(word() for _ in range(20)), r.choice(near), *passage, r.choice(near), r.choice(near), *(word() for _ in range(20))]) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for method, split, join in ((PrefixFreeParsing(60, 8, 6), lambda t: list(t.encode()), bytes), (RelativeLempelZiv(12, 4), str.split, lambda ws: " ".join(ws).encode())):
        got = {s.rid: s.spans for s in repeated_windows(docs, method, group).collect()}
        want = brute(texts, split, join, method.window)
        assert [int(covered(got.get(i), w[0], method.window).sum()) for i, w in enumerate(want)] == [w[1] for w in want]


def test_very_long_texts(spark):
    """Longer than a slice, with a passage that reaches over a slice's edge, one letter over and over, and a repeated line."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    passage = " ".join(word() for _ in range(300))
    long = " ".join(word() for _ in range(44_000))
    texts = [long[: (1 << 18) - 700] + passage + long[(1 << 18) - 700 :], passage, "z" * 300_000, "a line that comes again and again\n" * 9_000, "short"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {g.doc_id: tuple(g)[1:5] for g in remove_repeated_bytes(docs).collect()}
    want = brute(texts, lambda t: t.encode(), bytes, 400)
    assert [got[i] for i in range(len(texts))] == want
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    got = {g.doc_id: (g.n_words, g.n_removed, g.kept_sha256) for g in remove_repeated_words(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [(w[0], w[1], w[3]) for w in brute(texts, words, lambda ws: " ".join(ws).encode(), 35)]


def test_passages_shorter_and_longer_than_400_bytes(spark):
    """Passages of over 50 words in two documents each: bytes are lost from 400 on, words always."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(4, 6)))
    sizes, texts = (340, 397, 398, 399, 560), []
    for size in sizes:
        passage = " ".join(word() for _ in range(120))[:size]
        passage = passage[:-2] + "xy"  # no blank at the end
        assert len(passage.split()) > 50
        texts += [" ".join(word() for _ in range(90)) + f" {a} {passage} {b} " + " ".join(word() for _ in range(90)) for a, b in (("1:", ":2"), ("3;", ";4"))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {g.doc_id: g for g in remove_repeated_bytes(docs).collect()}
    around = 2  # the blanks beside a passage are shared, too
    want = [size + around if size + around >= 400 else 0 for size in sizes for _ in range(2)]
    assert [(got[i].n_bytes, got[i].n_removed) for i in range(len(texts))] == [(len(t), n) for t, n in zip(texts, want, strict=True)]
    assert all(g.n_removed > 50 for g in remove_repeated_words(docs).collect())


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_long_words_that_collide_in_polynomial_hashes(spark):
    common = [f"w{i}" for i in range(34)]
    texts = [" ".join([*common, thue_morse(1024)]), " ".join([*common, thue_morse(1024, "b", "a")])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeated_words(docs).collect()] == [0, 0]
    assert [r.n_removed for r in remove_repeated_bytes(docs, 1100).collect()] == [0, 0]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_bytes(none).collect() == [] and remove_repeated_words(none).collect() == []


def test_outputs(spark):
    rows = [(1, "abcdefgh-1234"), (2, "zz abcdefgh")]
    out = {r.doc_id: r for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8, keep_text=True).collect()}
    assert bytes(out[1].kept) == b"-1234" and out[2].removed[0].asDict() == {"start": 3, "end": 11}
