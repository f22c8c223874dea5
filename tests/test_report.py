"""Composed operations on a handful of outputs."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from lodestone.operators import chunk as ch
from lodestone.operators import fuzzy as fz
from lodestone.operators import indexed as ix
from lodestone.operators import report as rp
from lodestone.plans.queries import QUERIES
from lodestone.sources.options import Options
from lodestone.sources.store import Store


def outputs(spark):
    long = "\n\n".join(f"section {i} about {w}\nwidget_name {w}" for i, w in enumerate(["apples", "apples", "pears", "plums"]))
    return spark.createDataFrame([(1, "cmd one", "short", "apples"), (2, "cmd two", long, "apples"), (3, "cmd three", long, "zzz")], "doc_id long, source string, text string, intent string")


def test_intent_filter(spark, tmp_path):
    got = {r.doc_id: r.text for r in rp.intent_filter(Store(spark, str(tmp_path / "a")), outputs(spark), threshold=50).collect()}
    assert got[1] == "short"
    assert got[2].startswith('Indexed 4 sections from cmd two.\n3 sections matched "apples":\n\n  - **section 0 about apples**: section 0 about apples\nwidget_name apples\n')
    assert "\nSearchable terms: " in got[2] and got[2].endswith(rp.HINT)
    assert '0 sections matched "zzz":\n\n' in got[3]
    short = {r.doc_id: r.text for r in rp.intent_filter(Store(spark, str(tmp_path / "b")), outputs(spark), threshold=50, level="ultra").collect()}
    assert "**" not in short[2] and "terms" not in short[2] and short[2].endswith("→ search() for more")


def test_batch(spark):
    rows = [(1, 2, "b", "x"), (1, 1, "a", ""), (2, 1, "c", None)]
    got = {r.batch_id: r.text for r in rp.batch_text(spark.createDataFrame(rows, "batch_id long, ord int, label string, output string")).collect()}
    assert got == {1: "## a\n\n(no output)\n\n## b\n\nx\n\n", 2: "## c\n\n(no output)\n\n"}


def test_an_intent_finds_what_was_stored_before_and_by_any_layer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.index(spark.createDataFrame([(9, "older", "An older text names quinces.")], "doc_id long, source string, text string"))
    body = "\n\n".join(f"part {i} of the output on apples" for i in range(4))
    rows = [(1, "one", body, "quince"), (2, "two", body, "utpu"), (3, "three", body, "aples")]
    got = {r.doc_id: r.text for r in rp.intent_filter(store, spark.createDataFrame(rows, "doc_id long, source string, text string, intent string"), threshold=50).collect()}
    assert '1 sections matched "quince":\n\n  - **Output**: An older text names quinces.\n' in got[1]
    assert '3 sections matched "utpu"' in got[2] and '3 sections matched "aples"' in got[3]


def test_scope(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.index(outputs(spark))
    queries = spark.createDataFrame([(1, "plums"), (2, "short"), (3, "ppl"), (4, "shrt")], "query_id int, query string")
    got = {(r.query_id, r.scope, r.layer, r.source_id) for r in ix.scoped(store, queries, "cmd th").collect()}
    assert got == {(1, "source", "word", 3), (2, "all", "word", 1), (3, "source", "substring", 3), (4, "all", "fuzzy", 1)}


def words_of(letters, size, n):
    return " ".join("".join(t) for t in itertools.islice(itertools.product(letters, repeat=size), n))


def test_the_intents_query_corrects_to_any_word_of_the_outputs(spark, tmp_path):
    """``not`` is no word to search for, so it is corrected, to a word beyond the first 500 of its lengths and the first 10,000 of all."""
    rows = [(1, "one", "x1 y2 not " + words_of("abcde", 4, 600) + " " + words_of("abcdefghij", 5, 10_000) + " knot"), (2, "two", "short")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in QUERIES["intent_filter"](spark, str(tmp_path)).collect()}
    assert got[2] == "short" and ' sections matched "not":\n\n  - **' in got[1] and '0 sections matched' not in got[1]


def test_scope_corrects_to_words_beyond_the_first_500_of_their_length(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [(1, "cmd one", words_of("abcde", 7, 600)), (2, "cmd two", "zymurgy"), (3, "cmd three", "zymurgy sphinxes")]
    store.index(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    queries = spark.createDataFrame([(1, "zyqmurgy"), (2, "sphqinxes")], "query_id int, query string")
    got = {(r.query_id, r.scope, r.layer, r.source_id, r.corrected) for r in ix.scoped(store, queries, "cmd two").collect()}
    assert got == {(1, "source", "fuzzy", 2, "zymurgy"), (2, "all", "fuzzy", 3, "sphinxes")}


def test_search_calls(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.index(outputs(spark))
    start = dt.datetime(2024, 1, 1)
    calls = [(i, start + dt.timedelta(seconds=i), None, 2) for i in range(10)] + [(20, start + dt.timedelta(hours=1), "cmd two", 9), (21, start + dt.timedelta(hours=2), None, 1)]
    queries = [(c[0], n, q) for c in calls for n, q in enumerate(["apples", "appels", "zzzz"])]
    frames = spark.createDataFrame(calls, "call_id long, ts timestamp, source string, limit int"), spark.createDataFrame(queries, "call_id long, ord int, query string")
    got = {r.call_id: r for r in rp.search_calls(store, *frames).collect()}
    assert [got[i].calls_in_window for i in range(10)] == list(range(1, 11)) and got[20].calls_in_window == 1
    first = got[0].output.split("\n---\n\n")
    assert first[0].startswith("## apples\n\n--- [cmd t") and first[0].count("] ---\n### section") == 2
    assert first[1].startswith('## appels\n(corrected to: "apples")\n\n--- [') and first[2] == "## zzzz\nNo results found.\n" and len(first) == 3
    cut = got[3].output.split("\n---\n\n")
    assert cut[0].count("] ---\n") == 1 and cut[3] == "\n⚠ Search rate limited (4 calls in 60s). Results reduced to 1 per query."
    assert got[7].output.endswith("(8 calls in 60s). Results reduced to 1 per query.") and got[8].output == got[9].output == rp.BLOCKED
    assert "cmd three" not in got[20].output and got[20].output.count("] ---\n") == 4  # two sections, for each of two queries
    tight = {r.call_id: r.output for r in rp.search_calls(store, *frames, Options(search_max_bytes=10)).collect()}
    assert tight[0] == first[0]


def test_discovery(spark):
    docs = outputs(spark)
    now = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(i, 1, "execute", now, 1, 0, 0) for i in range(4)], "call_id long, user_id long, tool string, ts timestamp, bytes_returned long, bytes_indexed long, bytes_sandboxed long")
    row = rp.discovery(ch.chunk(docs), calls, fz.vocabulary(docs)).first()
    assert (row.n_sources, row.n_chunks, row.n_words) == (3, 9, 6)
    assert row.hints == ["batch commands"] and "apples" in row.terms
    none = rp.discovery(ch.chunk(docs.filter(F.lit(False))), calls, fz.vocabulary(docs)).first()
    assert none.hints == ["batch commands", "index more"]


def test_discovery_lines(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    log = "call_id long, user_id long, tool string, ts timestamp, bytes_returned long, bytes_indexed long, bytes_sandboxed long"
    text = lambda calls: "\n".join(r.line for r in sorted(rp.discovery_lines(store, calls).collect(), key=lambda r: (r.part, r.nth)))
    none = text(spark.createDataFrame([], log))
    assert none.startswith("## Knowledge Base Discovery\n\nNo content indexed yet.") and none.endswith("\n### Optimization Suggestions\n\n- Start by using `batch_execute` to run multiple commands at once")
    store.index(outputs(spark).select("doc_id", "source", "text").union(spark.createDataFrame([(7, "code", "# H\n```\nx\n```\n")], "doc_id long, source string, text string")), F.lit("2024-01-01").cast("timestamp"))
    calls = spark.createDataFrame([(i, 1, "search", dt.datetime(2024, 1, 1), 1, 0, 0) for i in range(6)], log)
    got = text(calls)
    assert "| Indexed sources | 4 |\n| Total chunks | 10 |\n| Vocabulary size | 6 |\n| Trigram index | lazy (not yet needed) |\n\n### Indexed Sources\n\n- **cmd one** — 1 chunks\n- **cmd two** — 4 chunks\n" in got
    assert "- **code** — 1 chunks (1 with code)\n\n### Top Searchable Terms\n\n" in got and got.endswith("Suggestions\n\n- **Batch your searches** — pass multiple queries in a single search() call")
    store.with_grams()
    assert "| Trigram index | active |" in text(calls)
