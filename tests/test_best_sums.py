"""Sums of many queries at once: tasks keep the best of each query, whatever the ties, blocks and source filters."""

import random

import pyarrow as pa
import pytest

from lodestone.operators import indexed as ix

QUERY = "query_id int, query string, source string, k int"


def batches(rows, size):
    columns = {"id": pa.int64(), "commit": pa.int64(), "source_id": pa.int64(), "chunk_ord": pa.int32(), "part": pa.float64()}
    for a in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a : a + size]], t) for i, t in enumerate(columns.values())], names=list(columns))


@pytest.mark.parametrize("at_once", [1, 50, 2_000_000])
def test_best_in_task_against_all_sums(monkeypatch, at_once):
    monkeypatch.setattr(ix, "SUMS_AT_ONCE", at_once)
    r = random.Random(3)
    rows = [(i, 7, None if s == 5 else s, c, r.choice([0.25, 0.5, 1.0])) for s in range(60) for c in range(2) for i in r.sample(range(9), r.randint(1, 6))]
    r.shuffle(rows)
    asked = [(q, i, r.randint(1, 2), k) for q, k in ((0, 3), (1, 1), (4, 500), (9, 0)) for i in r.sample(range(12), 5)]
    got = [tuple(x.values()) for b in ix.best_in_task(asked)(batches(rows, 17)) for x in b.to_pylist()]
    for q, k in ((0, 3), (1, 1), (4, 500), (9, 0)):
        times, sums = {i: t for p, i, t, _ in asked if p == q}, {}
        for i, commit, s, c, part in rows:
            if i in times:
                sums[commit, s, c] = sums.get((commit, s, c), 0.0) + part * times[i]
        order = lambda x: (-x[3], -1 if x[1] is None else x[1], x[2])
        best = sorted(((*key, v) for key, v in sums.items()), key=order)
        mine = sorted((x[1:] for x in got if x[0] == q), key=order)
        assert mine[:k] == best[:k] and (mine == best[:k] or at_once == 1)
    assert list(ix.best_in_task(asked)(iter([]))) == []


def test_no_task_gives_all_chunks_of_a_query(spark, tmp_path):
    from lodestone.operators.search import word_search
    from lodestone.operators.chunk import chunk
    from lodestone.sources.store import Store

    docs = spark.createDataFrame([(i, f"src{i % 2}", "common " * (1 + i % 5) + f"word{i % 7} tail") for i in range(400)], "doc_id long, source string, text string")
    store = Store(spark, str(tmp_path / "s"), buckets=2, parts=1)
    store.index(docs)
    queries = spark.createDataFrame([(0, "common", None, 2), (1, "common tail common", None, 3), (2, "word3 common", "SRC1", 4), (3, "none", None, 3)], QUERY)
    snapshot = store.snapshot()
    free = queries.filter("source IS NULL")
    assert ix.all_scores(snapshot, free).count() <= 5 * ix.tasks_of(snapshot, spark)  # all 800 sums before
    plain = lambda df: sorted((x.query_id, x["rank"], x.source_id, x.chunk_ord, x.label, round(x.score, 9)) for x in df.collect())
    assert plain(ix.top(ix.all_scores(snapshot, queries), snapshot, queries)) == plain(word_search(chunk(docs), queries))


def test_occurrences_overlap():
    assert (ix.occurrences("aaaa", "aa", True), ix.occurrences("abcabc", "abc", False), ix.occurrences("xyxyx", "xyx", True), ix.occurrences("", "a", False)) == (3, 2, 2, 0)
