"""The stored index: whole commits, two writers, and the same search results as without an index."""

import itertools
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fuzzy as fz
from lodestone.operators import indexed as ix
from lodestone.operators import search as se
from lodestone.operators.chunk import chunk
from lodestone.sources import store as st
from lodestone.sources.store import Store

DOCS = "doc_id long, source string, text string"
QUERY = "query_id int, query string, source string, k int"
WORDS = "run running runs happily happiness relational conditional hoping hopped agreed feed sky the the the of x1 été Straße snake_case integration-js-output İzmir".split()


def texts(n, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [" ".join(r.choices(WORDS, k=r.randint(1, 12))) + r.choice(["", ".", "!"]) for _ in range(r.randint(1, 50))]
        rows.append((i, f"src{i % 3}", r.choice(["\n", "\n\n"]).join(lines)))
    return rows + [(n, "none", None), (n + 1, "empty", "")]


QUERIES = [
    (0, "running", None, 5), (1, "running sky", None, 3), (2, "js-integration", None, 3), (3, "integration-js-output the", None, 50), (4, "unning", None, 9), (5, "the THE the", "src1", 4),
    (6, "zzzz", None, 3), (7, "", None, 3), (8, "snake_case run", "nowhere", 3), (9, "appi ele", "SRC2", 7), (10, "aaa", None, 3), (11, "ete strasse", None, 3), (12, "zmir", None, 3),
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store") / "s"), buckets=5, parts=2)
    docs = spark.createDataFrame(texts(40), DOCS)
    store.index(docs)
    return store, docs, spark.createDataFrame(QUERIES, QUERY)


def plain(df):
    return sorted((r.query_id, r["rank"], r.source_id, r.chunk_ord, r.label, r.title, r.content, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("stemmed", [False, True])
def test_words_as_without_an_index(made, stemmed):
    store, docs, queries = made
    want = plain(se.word_search(chunk(docs), queries, stemmed))
    assert want and plain(ix.word_search(store.snapshot(), queries, stemmed)) == want


def test_substrings_as_without_an_index(made):
    store, docs, queries = made
    want = plain(se.substring_search(chunk(docs), queries))
    assert want and plain(ix.substring_search(store.with_grams(), queries)) == want


def test_two_commits_search_as_one(spark, tmp_path, made):
    _, docs, queries = made
    store = Store(spark, str(tmp_path / "s"), buckets=3)
    store.index(docs.filter("doc_id < 17"))
    assert len(store.with_grams().filled) == 1
    store.index(docs.filter("doc_id >= 17"))
    before = store.snapshot()
    with pytest.raises(ValueError):
        ix.substring_search(before, queries)
    snapshot = store.with_grams()  # only the second commit is filled now
    assert len(snapshot.filled) == 2 and len({e["folder"] for e in snapshot.filled}) == 2
    assert plain(ix.word_search(snapshot, queries, True)) == plain(se.word_search(chunk(docs), queries, True))
    assert plain(ix.substring_search(snapshot, queries)) == plain(se.substring_search(chunk(docs), queries))
    assert store.with_grams().filled == snapshot.filled


def test_the_same_document_twice_is_two_sources(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, "a", "alpha beta"), (2, "a", "gamma delta")], DOCS)
    first, second = store.index(docs), store.index(docs)
    hits = ix.word_search(store.snapshot(), spark.createDataFrame([(0, "alpha", None, 5)], QUERY)).collect()
    assert {(r.commit, r.source_id) for r in hits} == {(first, 1), (second, 1)} and tuple(store.stats().first())[:2] == (4, 4)


def test_a_commit_that_fails_at_any_write_is_never_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, "a", "alpha beta")], DOCS)
    store.index(docs)
    queries = spark.createDataFrame([(0, "alpha", None, 5)], QUERY)
    old = store.snapshot()
    want = plain(ix.word_search(old, queries))
    put, publish = Store._put, st.publish
    for stop in ("chunks", "postings", "peaks", "stems", "vocabulary", "sources", "log"):

        def broken(self, folder, rows, name, *more, stop=stop):
            if name == stop:
                raise OSError("lost")
            put(self, folder, rows, name, *more)

        def unpublished(*more, stop=stop):
            if stop == "log":
                raise OSError("lost")
            publish(*more)

        monkeypatch.setattr(Store, "_put", broken)
        monkeypatch.setattr(st, "publish", unpublished)
        with pytest.raises(OSError):
            store.index(docs)
        monkeypatch.undo()
        now = store.snapshot()
        assert plain(ix.word_search(now, queries)) == want and tuple(store.stats().first()) == (1, 1, 2)
    store.index(docs)
    assert plain(ix.word_search(old, queries)) == want and store.snapshot().n_chunks == 2  # a snapshot stays as it is


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    Store(spark, path)
    failed = []

    def write(i):
        try:
            Store(spark, path, buckets=2).index(spark.createDataFrame([(i, f"s{i}", f"word{i} common")], DOCS))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Store(spark, path, buckets=2)
    assert not failed and sorted(r.source_id for r in store.sources.collect()) == [0, 1, 2, 3]
    hits = ix.word_search(store.snapshot(), spark.createDataFrame([(0, "common", None, 9)], QUERY)).collect()
    assert {r.source_id for r in hits} == {0, 1, 2, 3} and tuple(store.stats().first()) == (4, 4, 5)


def test_first_sight_of_words_over_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), vocabulary_limit=3)
    store.index(spark.createDataFrame([(9, "a", "zeta eta")], DOCS))
    store.index(spark.createDataFrame([(1, "a", "eta theta iota")], DOCS))
    assert {(r.word, r.first_doc) for r in store.vocabulary.collect()} == {("zeta", 9), ("eta", 9), ("theta", 1)}


def test_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    queries = spark.createDataFrame(QUERIES, QUERY)
    assert ix.word_search(store.snapshot(), queries, True).collect() == [] and ix.substring_search(store.with_grams(), queries).collect() == []
    assert tuple(store.stats().first()) == (0, 0, 0) and store.list_sources().collect() == []
    store.index(spark.createDataFrame([(1, "a", None)], DOCS))
    assert ix.word_search(store.snapshot(), queries).collect() == [] and ix.substring_search(store.with_grams(), queries).collect() == []


def test_only_the_buckets_asked_for_are_read_and_no_content_before_the_best(made):
    store, _, queries = made
    hits = ix.phrase_hits(store.snapshot(), queries.filter("query_id = 0"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and "content:string" not in plan and "_pos:array" not in plan


def skewed(n):
    """Two words in every chunk, some in a few of the later ones only."""
    r = random.Random(11)
    rows = []
    for i in range(n):
        words = ["the"] * r.randint(1, 9) + ["of"] * r.randint(1, 3) + r.choices([f"w{j}" for j in range(80)], k=r.randint(5, 40))
        if i % 97 == 5:
            words += ["rare"] * r.randint(1, 4) + ["the of"]
        r.shuffle(words)
        rows.append((i, f"s{i % 4}", " ".join(words)))
    return rows


def test_best_of_frequent_words_as_scoring_all(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(skewed(900), DOCS).coalesce(1)
    texts = ["the", "the of", "rare the", "rare of the w3", "the-of w7", "w1 w2 w3", "the the", "unseen", "of"]
    queries = spark.createDataFrame([(i, t, None, k) for i, (t, k) in enumerate(zip(texts, [3, 5, 1, 4, 2, 3, 7, 3, 2000], strict=True))], QUERY)
    monkeypatch.setattr(ix, "FREQUENT", 300)
    monkeypatch.setattr(ix, "PEAK_BITS", 4)
    store = Store(spark, str(tmp_path / "s"), buckets=3, parts=2)
    store.index(docs.filter("doc_id < 600"))
    store.index(docs.filter("doc_id >= 600 AND doc_id < 750"))  # here nothing is frequent
    store.index(docs.filter("doc_id >= 750 OR doc_id = 3"))
    snapshot, seen = store.snapshot(), []
    assert {r.token for r in snapshot._table("peaks", st.PEAKS).collect()} == {"the", "of", "output"}  # the last is a title
    kept = ix.stored
    monkeypatch.setattr(ix, "stored", lambda df, name: seen.append((name, out := kept(df, name))) or out)
    got = plain(ix.word_search(snapshot, queries))
    tables = dict(seen)
    size = lambda name, q: tables[name].filter(F.col("query_id") == q).count()
    monkeypatch.setattr(ix, "stored", kept)
    wanted = ix.asked_phrases(snapshot, queries)
    hits = ix.hits_of(snapshot.postings_of(wanted).join(wanted, "token"), wanted)
    assert got == plain(ix.top(ix.bm25(hits, snapshot.n_chunks, snapshot.n_tokens), snapshot, queries)) and len(got) > 900
    assert size("blocks", 2) < size("bounds", 2) / 3 and size("blocks", 0) < size("bounds", 0) and size("blocks", 8) == size("bounds", 8)


def test_gram_candidates_hold_the_word_or_share_its_grams(made, spark):
    store, docs, _ = made
    words = spark.createDataFrame([("unning",), ("ele",), ("qqq",), ("the of",)], "word string")
    snapshot = store.with_grams()
    got = {}
    for r in ix.gram_candidates(snapshot, words).join(snapshot.chunks, ["commit", "cid"]).collect():
        got.setdefault(r.word, set()).add((r.source_id, r.chunk_ord))
    rows = snapshot.chunks.select("source_id", "chunk_ord", F.lower("title").alias("t"), F.lower("content").alias("c")).collect()
    for w in ("unning", "ele", "qqq", "the of"):
        assert got.get(w, set()) >= {(r.source_id, r.chunk_ord) for r in rows if w in r.t or w in r.c}
    assert "qqq" not in got


def test_a_cascade_corrects_to_words_beyond_the_first_500_of_their_length(spark, tmp_path):
    """Not one of the others is near the words asked for; lengths of all three bounds."""
    want = {0: "fox", 1: "zymurgy", 2: "uvulopalatoplasty"}
    others = [" ".join("".join(t) for t in itertools.islice(itertools.product("abcde", repeat=len(w)), 600)) for w in ("aaaa", *list(want.values())[1:])]
    docs = spark.createDataFrame([(i, "others", t) for i, t in enumerate(others)] + [(9, "last", " ".join(want.values()))], DOCS)
    store = Store(spark, str(tmp_path / "s"), buckets=3, parts=2)
    store.index(docs)
    queries = spark.createDataFrame([(0, "fqox", None, 3), (1, "zyqmurgy", None, 3), (2, "uvuqlopalatoqplastq", None, 3)], QUERY)
    every = {(q, "fuzzy", 9, w) for q, w in want.items()}
    assert {(r.query_id, r.layer, r.source_id, r.corrected) for r in ix.cascade(store, queries).collect()} == every
    assert {(r.query_id, r.layer, r.source_id, r.corrected) for r in se.cascade(chunk(docs), queries, fz.vocabulary(docs)).collect()} == every
    assert ix.cascade(store, queries, candidates=500).collect() == []
