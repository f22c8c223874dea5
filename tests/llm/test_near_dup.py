"""Near-duplicate components against brute force over all pairs."""

import random
import re
from collections import Counter

import pytest

import lodestone.llm.near_dup as m
from lodestone.llm.components import connected

SCHEMA = "doc_id long, text string, v string, rid int, root double"


def brute(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), (c := least.get(find(i)) if sets[i] else d), d == c) for i, (d, _) in enumerate(rows)]


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉ") for _ in range(3))
    bases = [[word() for _ in range(r.randint(1, 120))] for _ in range(12)]
    texts = [None, "", "  \n", "one", "one two", "ONE TWO", "one two three", "ÉÉ x", "éé x"]
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, max(1, len(w) // 12))):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w += [word() for _ in range(len(w) // 8)]
        t = r.choice((" ", "\t", "\n")).join(w)
        texts.append(t.upper() if r.random() < 0.05 else t)
    texts += texts[-20:] + ["same copy of it all"] * 40
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [(i if i % 31 else None, t) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize(("k", "percent", "block", "crowd", "seed"), [(3, 85, 150_000, 16, 1), (5, 80, 700, 4, 2), (3, 85, 400, 2, 3)])
def test_components(spark, monkeypatch, k, percent, block, crowd, seed):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "CROWD", crowd)
    rows = corpus(seed, 220)
    docs = spark.createDataFrame([(d, t, "x", 1, 0.5) for d, t in rows], SCHEMA).repartition(6)
    got = m.near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    # Rows without a doc_id count as kept only if their component has no id; whether it has is in component_id.
    got = Counter((d, n, c, d is not None and kept) for d, n, c, kept in got)
    assert got == Counter((d, n, c, d is not None and kept) for d, n, c, kept in brute(rows, k, percent))


def test_one_stays(spark):
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (9, "other words are here now"), (7, None), (8, ""), (2, "A b c d e f")]
    out = m.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text"))
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 8, 9] and out.columns == ["doc_id", "text"]


def test_one_stays_on_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda i: " ".join([*base[:i], "other", *base[i + 1 :]])
    far = lambda i: near(i).replace("w", "x")
    rows = [(None, near(i)) for i in (0, 1, 58, 59)] + [(3, far(0)), (3, far(59)), (3, far(59)), (None, far(1)), (None, None), (None, "")]
    out = m.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 0, 3]
    assert sum("w2 " in (r.text or "") for r in out) == sum("x2 " in (r.text or "") for r in out) == 1


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert m.near_duplicates(none).collect() == [] and m.one_of_each_group(none).collect() == []


def test_no_pair_within_the_distance_is_dropped(spark):
    places = m.chunks_for(80) * m.CHUNK
    sig = lambda n: b"".join((6 <= i < 6 + n).to_bytes(2, "little") for i in range(places))
    name = lambda i: bytes([i] * 16)
    nodes = spark.createDataFrame([(name(1), sig(0)), (name(2), sig(31)), (name(3), sig(50))], "v binary, sig binary")
    assert 31 == 2 * m.chunks_for(80) - 1
    assert sorted((bytes(a), bytes(b)) for a, b in m._candidates(nodes).collect()) == [(name(2), name(1)), (name(3), name(2))]


def test_sequences_that_collide_in_polynomial_hashes(spark):
    order = lambda a, b: " ".join(b if bin(i).count("1") % 2 else a for i in range(4096))
    letters = order("a", "b").replace(" ", "")
    rows = [(1, order("x", "y")), (2, order("y", "x")), (3, letters), (4, letters.translate({97: 98, 98: 97}))]
    got = {r.doc_id: r.component_id for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: c for d, _, c, _ in brute(rows, 5, 80)}
    assert got == want and got[3] == 3 and got[4] == 4


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (95, 95), (7, 3), (7, 3), (300 + 2**40, 5)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[300 + 2**40] == 0 and got[1050] == 1000
    assert 95 in got and len(got) == 41 + 3 + 1 + 60
