"""Mixing: targets against a plain computation, totals, whole copies, reruns, and no Python in the plan."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, target string, size int, copies string, uid double"


def plain_targets(sizes):
    """Water filling by rounds: whoever is above twice its size is fixed there, the rest is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}


def documents(seed, n, sources):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice((0, 1, 3, 30, 200)))), r.choice(sources)) for i in range(n)]
    rows += [(None, "a b\tc", sources[0]), (3, "x y", None), (4, None, None), (5, "dup dup", "b"), (5, "dup dup", "b"), (None, "a b\tc", sources[0])]
    return [(d, t, s, "x", 1, "y", 0.5) for d, t, s in rows]


@pytest.mark.parametrize(("seed", "sources"), [(1, ["a", "b", "c", None, "é", "Z"]), (2, ["a"] * 20 + ["b", "c"]), (3, [None])])
def test_mix(spark, seed, sources):
    rows = documents(seed, 900, sources)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = m.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((g.doc_id, g.source, g["size"]) for g in got) == Counter((r[0], r[2], count(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += count(r[1])
    want, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source])
        assert g.taken == g.copies * g["size"] and 0 <= g.copies <= 2
        assert g["size"] == 0 or int(g.target / g.source_size) <= g.copies <= int(g.target / g.source_size) + 1
        taken[g.source] += g.taken
        largest[g.source] = max(largest[g.source], g["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = m.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert Counter(tuple(g) for g in got) == Counter(tuple(g) for g in again)
    mixed = m.mixed_documents(docs)
    assert mixed.columns == docs.columns
    total = defaultdict(int)
    for g in mixed.collect():
        total[g.source] += count(g.text)
    assert {s: n for s, n in total.items() if n} == {s: n for s, n in taken.items() if n}


def test_expectation(spark):
    """Over many seeds a document is taken about target / size times."""
    rows = [(i, "w " * (1 + i % 5), "a", "", 0, "", 0.0) for i in range(30)] + [(100, "w " * 400, "b", "", 0, "", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    n = Counter()
    for seed in range(12):
        n.update({g.doc_id: g.copies for g in m.mix(docs, weights=(1, 3), percent=50, seed=seed).collect()})
    ratio = plain_ratio = m.mix(docs, weights=(1, 3), percent=50).filter("doc_id = 0").first()
    assert sum(n[i] for i in range(30)) / (12 * 30) == pytest.approx(plain_ratio.target / ratio.source_size, rel=0.25)


def test_native_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert m.mix(none).collect() == [] and m.mixed_documents(none).collect() == []
    plan = m.mix(spark.createDataFrame(documents(1, 20, ["a", "b"]), SCHEMA).cache())._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
