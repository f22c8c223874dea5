"""Work that must not grow faster than the input: what is made a row, and what meets each query apart."""

from lodestone.operators import indexed as ix
from lodestone.operators import search as se
from lodestone.operators.chunk import chunk
from lodestone.sources.store import Store

DOCS = "doc_id long, source string, text string"
QUERY = "query_id int, query string, source string, k int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_and_grams_make_no_row_for_each_occurrence(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.index(spark.createDataFrame([(1, "a", "the cat the dog"), (2, "b", "Ωμέγα 😀ab the")], DOCS))
    chunks = store.snapshot().chunks
    posted, grams = ix.postings(chunks), ix.gram_postings(chunks)
    for made in (posted, grams):
        assert "Generate" not in plan(made) and "Exchange" not in plan(made) and "Aggregate" not in plan(made)
    assert {(r.source_id, r.token, r.weighted, *r.content_pos) for r in posted.filter("token IN ('the', 'output')").collect()} == {(1, "the", 2.0, 0, 2), (1, "output", 2.0), (2, "the", 1.0, 2), (2, "output", 2.0)}
    assert {r.gram for r in grams.collect()} >= {"ωμέ", "😀ab", "out"}
    hits = ix.substring_search(store.with_grams(), spark.createDataFrame([(0, "😀ab", None, 3)], QUERY)).collect()
    assert [r.source_id for r in hits] == [2]


def test_many_queries_share_phrases_as_each_alone(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 3}", " ".join(f"w{(i * j) % 7}" for j in range(1, 9)) + (" running-runs" if i % 5 else " ran run")) for i in range(60)], DOCS)
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.index(docs)
    texts = ["w1 w2 w1", "w1-w2", "w2-w3-w1 w4", "running-runs run", "run-runs w1-w2", "none-w1"]
    queries, snapshot = spark.createDataFrame([(i, t, None if i % 2 else "S1", i + 1) for i, t in enumerate(texts)], QUERY), store.snapshot()
    plain = lambda df: sorted((r.query_id, r["rank"], r.source_id, r.chunk_ord, round(r.score, 9)) for r in df.collect())
    monkeypatch.setattr(ix, "BLOCK_OF_TOKENS", 4)  # more than one pass
    want = plain(se.word_search(chunk(docs), queries, True))
    assert want and plain(ix.word_search(snapshot, queries, True)) == want
    same = lambda df: sorted((r.query_id, r.phrase, r.source_id, r.chunk_ord, r.weighted) for r in df.collect())
    assert same(ix.phrase_hits(snapshot, queries)) == same(se.phrase_hits(chunk(docs), queries))
    _, each = ix.keyed_phrases(snapshot, queries)
    assert each.select("id").distinct().count() == 9


def test_equal_queries_are_answered_once(spark, tmp_path, monkeypatch):
    store, seen = Store(spark, str(tmp_path / "s"), buckets=2), []
    store.index(spark.createDataFrame([(i, "s", f"alpha w{i}") for i in range(5)], DOCS))
    search = ix.word_search
    monkeypatch.setattr(ix, "word_search", lambda snapshot, queries, *more: seen.append(queries.count()) or search(snapshot, queries, *more))
    got = ix.cascade(store, spark.createDataFrame([(i, "alpha", None, 2) for i in range(6)], QUERY)).collect()
    assert seen[0] == 1 and sorted((r.query_id, r["rank"]) for r in got) == [(i, n) for i in range(6) for n in (1, 2)]
