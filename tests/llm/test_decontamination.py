"""Edit matching against a full dynamic programme over every place."""

import random

import pytest

import lodestone.llm.decontamination as m


def least(pattern, text):
    """Least edit distance of pattern to any part of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(r, text, n):
    s = list(text)
    for _ in range(n):
        at = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(at, r.choice("abcé "))
        elif s and at < len(s):
            if kind == 1:
                s[at] = r.choice("abcé")
            else:
                del s[at]
    return "".join(s)


def test_myers():
    r = random.Random(3)
    for _ in range(400):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 70)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 40))) + edited(r, p, r.randint(0, 6)) + "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        want = least(p, t)
        got = m.myers(p, t, 5)
        assert got is None if want > 5 else got[0] == want


@pytest.mark.parametrize("block", [4_000_000, 150])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_CHARS", block)
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 5))) for _ in range(n))
    items = [(i, words(r.randint(8, 30))) for i in range(8)] + [(100, None), (101, " "), (None, words(12)), (102, "Tiny")]
    items.append((103, items[0][1]))
    docs = [(None, "x " + items[1][1].upper()), (1, None), (2, ""), (3, "tiny tinY"), (4, items[0][1] + " " + items[0][1])]
    for i in range(60):
        parts = [words(r.randint(0, 20))]
        if r.random() < 0.8:
            parts.append(edited(r, r.choice([t for _, t in items if t and t.strip()]).replace(" ", "\n "), r.randint(0, 8)))
        docs.append((10 + i, " ".join([*parts, words(3)])))
    want = set()
    for d, t in docs:
        for i, p in items:
            if t and p and p.strip():
                p, n = m.normal(p), m.normal(t)
                if (e := least(p, n)) <= int(len(p) * m.RATE):
                    want.add((d, i, e))
    schema = "doc_id long, text string, item_id string, end int"
    frame = spark.createDataFrame([(*d, "x", 0) for d in docs], schema).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.distance) for x in m.leaks(frame, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = m.without_leaks(frame, bench)
    assert left.columns == frame.columns and {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _, _ in want}
    assert m.leaks(frame, bench.limit(0)).collect() == [] and m.leaks(frame.limit(0), bench).collect() == []
    assert m.without_leaks(frame, bench.limit(0)).count() == len(docs)
