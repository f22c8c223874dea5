"""Ranked search against the scores of all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import ranked_search as rs
from lodestone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(rs.UPPER, rs.LOWER)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, k):
    """Sorted (item_id, rank, doc_id, score)."""
    rows = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    big_n, big_l = sum(n > 0 for _, _, n in rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in rows:
            m = 50 + 50 * n * big_n // big_l if big_l else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d if d is not None else -(1 << 63), d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Straße", "日本語", "ÀB", "À"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(0, 40)] + [(5, docs[9][1]), (5, docs[9][1]), (None, docs[3][1]), (None, None), (n + 99, ""), (n + 100, "-- \x00.\x7f"), (n + 101, "w0 " * 70_000 + "w7,W8")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(7, "w0"), (7, "w0 w1 W0"), (None, "w3"), (99, None), (98, ""), (97, "unseen"), (96, "w1" * 3 + " À")]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equals_scoring_all(spark, monkeypatch, k):
    docs, items = corpus(700)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, shard int")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, qid string")
    want = brute(docs, items, k)
    assert found(rs.ranked_search(d, i, k)) == want
    if k == 7:  # items in several groups
        monkeypatch.setattr(rs, "ITEMS", 5)
        assert found(rs.ranked_search(d, i, k)) == want


@pytest.mark.parametrize("block, shard, span", [(1, 9, 4), (3, 50, 16), (8, 4096, 1), (128, 200, 1024)])
def test_blocks_windows_and_shards_of_any_size(monkeypatch, block, shard, span):
    monkeypatch.setattr(rs, "BLOCK", block)
    monkeypatch.setattr(rs, "SPAN", span)
    docs, items = corpus(300)
    docs = [(d if d is not None else None, t or "") for d, t in docs]
    big_n, big_l = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    df, batches = Counter(t for _, x in docs for t in set(terms(x))), []
    for i in range(0, len(docs), shard):
        part = docs[i : i + shard]
        batches.append(rs.shard_rows(i, [d for d, _ in part], [t for _, t in part], big_n, big_l).to_pylist())
    for k in (1, 10):
        want = brute(docs, items, k)
        got = []
        for item, text in items:
            best = rs.Best(k)
            for rows in batches:
                s = rs.Shard(rows[0]["payload"])
                own = [s.add(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[r["term"]] + 1))), r["blocks"], r["payload"]) for r in rows[1:] if r["term"] in set(terms(text))]
                if own:
                    s.close()
                    rs.search_shard(s, own, best)
            order = np.lexsort((best.ids, -best.scores))[:k]
            got += [(item, n + 1, None if best.ids[j] == rs.NO_ID else int(best.ids[j]), int(best.scores[j])) for n, j in enumerate(order)]
        assert sorted(got, key=str) == want


def test_blocks_below_the_least_score_stay_compressed():
    rng = random.Random(1)
    texts = [("rare rare rare " if i % 1000 == 7 else "") + "the " * rng.randint(1, 3) + "of and" for i in range(4000)]
    rows = rs.shard_rows(0, list(range(4000)), texts, 4000, sum(len(terms(t)) for t in texts)).to_pylist()
    shard = rs.Shard(rows[0]["payload"])
    own = [shard.add({"rare": 5000}.get(r["term"], 1), r["blocks"], r["payload"]) for r in rows[1:]]
    shard.close()
    best = rs.Best(1)
    rs.search_shard(shard, own, best)
    assert len(shard.known) < shard.total / 2  # three words in every document, 32 blocks each
    assert {int(i) % 1000 for i in best.ids} == {7}


def test_numbers_in_seven_bits():
    rng = random.Random(2)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, *(rng.randrange(1 << rng.randint(1, 31)) for _ in range(500))])
    body, at = rs.packed(values)
    assert np.array_equal(rs.unpacked(body), values) and at[-1] == len(body)
    assert rs.unpacked(rs.packed(values[:0])[0]).tolist() == []


def test_empty_tables(spark):
    docs, items = corpus(50)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(rs.ranked_search(d.limit(0), i)) == []
    assert found(rs.ranked_search(d, i.limit(0))) == []
    assert found(rs.ranked_search(d.filter("text IS NULL"), i)) == []


def test_an_index_is_written_once_and_asked_again(spark, tmp_path):
    docs, items = corpus(100)
    index = rs.write_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), f"{tmp_path}/index")
    for part in (items[:5], items[5:]):
        assert found(rs.search(index, spark.createDataFrame(part, "item_id long, text string"), 9)) == brute(docs, part, 9)


def test_query_against_all_scores_and_sql(spark):
    got = found(QUERIES["op12_ranked_search"](spark, SF))
    rows = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    assert got == brute(rows("documents", ("doc_id", "text")), rows("benchmark", ("item_id", "text")), 50)
    sql = ORACLE_SQL["op12_ranked_search"].replace("FROM documents", f"FROM '{SF}/documents.parquet'").replace("FROM benchmark", f"FROM '{SF}/benchmark.parquet'")
    assert sorted(duckdb.sql(sql).fetchall(), key=str) == got
