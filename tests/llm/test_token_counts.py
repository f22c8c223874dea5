"""Token counts against the library's own encoding of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import token_counts as tc
from lodestone.llm.queries import QUERIES, public_tokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizer("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, uid string, n_bytes string, k double"


def expected(texts):
    t = tc.loaded(PATH)[0]
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def awkward(n: int) -> list[str]:
    rng = random.Random(7)
    space = [" ", "  ", "\n", " \n\t", "\u2003", "\xa0 ", " \u200b", "\x1c ", "\u180e ", "\ufeff", "\x85 ", " " * 50]
    words = ["'s", "'re", "'ll ", "'", "<|endoftext|>", "<|endof", "text|>", "don't", "word", "\u00c9lan", "\u65e5\u672c\u8a9e", "\U0001f642", "12", "3.14", "--", "...", "a" * 40, "xyz" * 60, "\u0663", "\u0308"]
    return ["".join(rng.choices(space + words, k=rng.randint(0, 90))) for _ in range(n)]


def test_awkward_texts_in_short_chunks(spark):
    texts = [*awkward(150), None, "", " ", "x" * 5000, "ab " * 3000, "<|endoftext|>" * 300, " " * 3000, "'re" * 900, "long" * 400 + " " + "longer" * 900 + " end"]
    docs = spark.createDataFrame([(i, t, "u", "n", 1.5) for i, t in enumerate(texts)], SCHEMA)
    for chunk, overlap in ((64, 16), (200, 25), (32_768, 512)):
        rows = {r.doc_id: r for r in tc.token_counts(docs, PATH, chunk=chunk, overlap=overlap).collect()}
        assert [rows[i].n_tokens for i in range(len(texts))] == expected(texts), (chunk, overlap)
        assert all(rows[i].n_bytes == len((t or "").encode()) and rows[i].over_limit == (rows[i].n_tokens > 512) for i, t in enumerate(texts))


def test_overlaps_are_widened_only_where_needed(spark):
    docs = spark.createDataFrame([(0, 0, 0, "some words " * 100), (1, 1, 0, "x" * 700 + " some words" * 30)], "uid long, doc_id long, n_bytes long, text string")
    chunks = tc.cut(docs, 128, 32)
    found = {r.uid: r.apart for r in tc.spliced(tc.encoded(chunks, PATH, 128, 32)).collect()}
    assert found[0] == 0 and found[1] > 0
    wider = tc.widened(chunks, spark.createDataFrame([(1,)], "uid long"), 128, 32).orderBy("k").collect()
    text = "x" * 700 + " some words" * 30
    assert [(r.size, r.text) for r in wider] == [(min(512, len(text) - i), text[i : i + 512 + 128]) for i in range(0, len(text), 512)]


def test_a_contraction_or_special_string_at_the_end_of_a_chunk_is_no_boundary():
    margin = tc.loaded(PATH)[1]
    assert margin == len("<|endoftext|>")
    whole, cut = tc.boundaries(PATH, "we'll")[0], tc.boundaries(PATH, "we'l")[0]
    assert 3 in cut and 3 not in whole  # the cut text alone would end a piece behind the apostrophe


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b " * 100), (5, "a b " * 100), (5, "a b " * 100), (None, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.n_tokens) for r in tc.token_counts(docs, PATH, chunk=64, overlap=16).collect())
    n = expected(["a b " * 100])[0]
    assert rows == [(-1, 0), (-1, n), (5, n), (5, n)]
    assert tc.token_counts(docs.limit(0), PATH).collect() == []
    assert tc.token_counts(docs, PATH, chunk=64, overlap=16).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    with pytest.raises(ValueError):
        tc.token_counts(docs, PATH, chunk=64, overlap=17)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.loaded(public_tokenizer("word_bpe_49k.json"))


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    counter = tc.Counter(PATH)
    texts = [" ".join(f"w{i}" for i in range(j, j + 30)) for j in range(0, 600, 10)]
    for t in texts:
        assert counter.count([t, "z" * 90]) == expected([t, "z" * 90])
        assert len(counter.known) <= 50


def test_query_on_the_table(spark):
    found = {r.doc_id: r.n_tokens for r in QUERIES["op13_token_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert found == dict(zip([r.doc_id for r in docs], expected([r.text for r in docs]), strict=True))
