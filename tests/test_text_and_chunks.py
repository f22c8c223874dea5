"""Text primitives and chunkers against small models."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunk as ch

JS_SPACE = " \t\n\r\x0b\x0c\xa0﻿    　"


def model_plain(text):
    ls, parts = text.split("\n"), re.split(r"\n\s*\n", text)
    if 3 <= len(parts) <= 200 and all(len(p) < 5120 for p in parts):
        out = [p.strip(JS_SPACE) for p in parts]
        return [(p.split("\n")[0][:80], p) for p in out if p]
    if len(ls) <= 20:
        return [("Output", text.strip(JS_SPACE))]
    out = []
    for i in range(0, len(ls), 18):
        part = ls[i : i + 20]
        body = "\n".join(part).strip(JS_SPACE)
        if body:
            out.append((part[0].strip(JS_SPACE)[:80] or f"Lines {i + 1}-{i + len(part)}", body))
    return out


def model_markdown(text):
    out, path, held, code, fence = [], [], [], False, False

    def flush():
        nonlocal held, code
        body = "\n".join(held).strip(JS_SPACE)
        if body:
            out.append((" > ".join(path) or body[:80], body, code))
        held, code = [], False

    for line in text.split("\n"):
        if line.startswith("```"):
            fence, code = not fence, True
        elif not fence and re.fullmatch(r"[-_*]{3,}\s*", line):
            flush()
            continue
        elif not fence and (h := re.fullmatch(r"(#{1,4})\s+([^\n\r]+)", line)):
            flush()
            path[len(h[1]) - 1 :] = []
            path.append(h[2].strip(JS_SPACE))
        held.append(line)
    flush()
    return out


def rows(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return {r.i: r.c for r in df.select("i", column(F.col("t")).alias("c")).collect()}


def test_plain(spark):
    r = random.Random(1)
    line = lambda: r.choice(["", " ", "word", "  two words ", "x" * 90, "é\t"])
    texts = ["", "\n", "one", "a\n\nb\n\nc", "\n\n\n\n", "\n".join("l" for _ in range(20)), "\n".join("l" for _ in range(21)), "\n".join(str(i) for i in range(38)), "\n".join(str(i) for i in range(39))]
    texts += ["\n\n".join("s" for _ in range(n)) for n in (2, 3, 200, 201)] + ["a\n\nb\n\n" + "c" * n for n in (5119, 5120)]
    texts += ["\n".join(line() for _ in range(r.randint(1, 70))) for _ in range(60)]
    got = rows(spark, texts, ch.plain_chunks)
    for i, t in enumerate(texts):
        assert [(c.title, c.content) for c in got[i]] == model_plain(t), t


def test_markdown(spark):
    r = random.Random(2)
    line = lambda: r.choice(["", "text", "# A", "## B b ", "### C", "#### D", "##### no", "#no", "---", "-*_", "***  ", "```", "```py", "  ```", "more\r"])
    texts = ["### a\n### b\n### c\nx\n### d", "```\n# in\n---", "# t", "intro\n# h\n---\nafter", "---", "x\n---\n"]
    texts += ["\n".join(line() for _ in range(r.randint(1, 30))) for _ in range(150)]
    got = rows(spark, texts, ch.markdown_chunks)
    for i, t in enumerate(texts):
        assert [(c.title, c.content, c.has_code) for c in got[i]] == model_markdown(t), t


def test_paths_by_depth(spark):
    got = rows(spark, ["### a\n### b\n### c\n### d"], ch.markdown_chunks)[0]
    assert [c.title for c in got] == ["a", "a > b", "a > b > c", "a > b > d"]


def test_detection(spark):
    texts = ["# one heading", "# one\ntwo", "a --- b", "x ``` y", "plain", "# one\n", "##### five"]
    assert [rows(spark, texts, ch.is_markdown)[i] for i in range(7)] == [True, False, True, True, False, False, False]


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "a", "# A\n```\nx\n```\n## B\ny"), (2, "b", None), (3, "c", "")], "doc_id long, source string, text string")
    found = ch.chunk(docs).orderBy("source_id", "chunk_ord").collect()
    assert [(c.source_id, c.chunk_ord, c.title, c.content_type) for c in found] == [(1, 0, "A", "code"), (1, 1, "A > B", "text"), (3, 0, "Output", "text")]
    assert {tuple(r) for r in ch.index_summary(ch.chunk(docs)).collect()} == {(1, "a", 2, 1), (3, "c", 1, 0)}


@pytest.mark.parametrize(("n", "want"), [(500, "500B"), (1023, "1023B"), (2048, "2.0KB"), (1587, "1.5KB"), (1588, "1.6KB"), (5 * 2**20, "5.0MB"), (0, "0B")])
def test_format_bytes(spark, n, want):
    assert spark.range(1).select(tx.format_bytes(F.lit(n))).first()[0] == want


def test_tokens_fold(spark):
    texts = ["Café NAÏVE foo_bar don't 12.5 x²y 日本語", "école ộ ß œ Ångström", ""]
    got = rows(spark, texts, tx.tokens)
    assert got[0] == ["cafe", "naive", "foo", "bar", "don", "t", "12", "5", "x²y", "日本語"]
    assert got[1] == ["ecole", "ộ", "ß", "œ", "angstrom"] and got[2] == []


def test_trim_and_code_points(spark):
    texts = [" ﻿\xa0a b\n\t ", "\n", "x"]
    assert list(rows(spark, texts, tx.js_trim).values()) == ["a b", "", "x"]
    got = spark.range(1).select(*[tx.code_point(F.lit(n)) for n in (65, 0x1F600, 0, 0x110000, 0xE9)]).first()
    assert list(got) == ["A", "\U0001f600", "", "", "é"]
    assert unicodedata.normalize("NFC", got[4]) == "é"


def test_substring_count(spark):
    df = spark.createDataFrame([("aaaaaa", "aaa"), ("a.b.a.b", "a.b"), ("x\\Ey", "\\E"), ("", "a")], "t string, w string")
    assert [r[0] for r in df.select(tx.substring_count(F.col("t"), F.col("w"))).collect()] == [4, 2, 1, 0]


def test_like_source(spark):
    df = spark.createDataFrame([("Docs/API", "api"), ("Docs", "d_c"), ("a\\b", "\\"), ("ÉCOLE", "école"), ("x", "%")], "l string, p string")
    assert [r[0] for r in df.select(tx.like_source(F.col("l"), F.col("p"))).collect()] == [True, True, True, False, True]
