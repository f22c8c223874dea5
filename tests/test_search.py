"""Ranking against stated golden values and an embedded full-text engine; correction, snippets, terms."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fuzzy as fz
from lodestone.operators import search as se
from lodestone.operators import snippet as sn
from lodestone.operators import terms as te
from lodestone.operators.stem import stem

ROWS = [
    (1, "Deploy guide", "deploy the service to production deploy again"),
    (2, "Health", "run smoke checks after deployment"),
    (3, "Misc", "nothing relevant in here at all really"),
    (4, "Café notes", "integration-js-output from quasar_token naïve Ångström"),
    (5, "JavaScript", "JavaScript runtime behavior and tooling details."),
]
QUERY = "query_id int, query string, source string, k int"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, 0, f"Source/{i}", t, c) for i, t, c in ROWS]
    return spark.createDataFrame(rows, "source_id long, chunk_ord int, label string, title string, content string").cache()


def ask(spark, texts, source=None, k=3):
    return spark.createDataFrame([(i, t, source, k) for i, t in enumerate(texts)], QUERY)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.source_id, round(r.score, 9)))
    return {q: [(s, x) for _, s, x in sorted(v)] for q, v in out.items()}


def test_golden(spark, chunks):
    got = found(se.word_search(chunks, ask(spark, ["deploy", "deploying deploy", "deploy smoke", "integration-js-output", "js-integration", "cafe", "###!!! smoke", "", "###!!!"]), stemmed=True))
    assert got == {0: [(1, 1.819818944)], 1: [(1, 3.639637888)], 2: [(1, 1.819818944), (2, 1.223770651)], 3: [(4, 0.99667919)], 5: [(4, 1.411355933)], 6: [(2, 1.223770651)]}


def test_golden_substrings(spark, chunks):
    got = found(se.substring_search(chunks, ask(spark, ["vascr", "javscript", "va", "cafe", "CAFÉ"])))
    assert got == {0: [(5, 1.681354459)], 4: [(4, 1.411355933)]}


def test_idf_floor(spark):
    rows = [(i, 0, "s", "a", "common word") for i in range(4)] + [(9, 0, "s", "b", "other")]
    frame = spark.createDataFrame(rows, "source_id long, chunk_ord int, label string, title string, content string")
    got = se.word_search(frame, ask(spark, ["common"], k=10)).collect()
    assert len(got) == 4 and all(abs(r.score - 9.71608832807571e-07) < 1e-12 for r in got)


def test_against_engine(spark):
    """Random English-like chunks; phrases of one and two words; scores to nine decimals."""
    import random

    r = random.Random(5)
    words = "run running runs happily happiness relational conditional hoping hopped agreed feed sky cries ponies generalizations electricity adjustable probate rate controlling x1 été".split()
    rows = [(i, 0, "s", " ".join(r.choices(words, k=r.randint(0, 4))), " ".join(r.choices(words, k=r.randint(1, 40)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(title, content, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    db.executemany("INSERT INTO t(rowid, title, content) VALUES (?, ?, ?)", [(i + 1, t, c) for i, _, _, t, c in rows])
    frame = spark.createDataFrame(rows, "source_id long, chunk_ord int, label string, title string, content string")
    texts = [*words, "running sky", "relational-feed", "hopped_cries x1", "ete"]
    got = {q: dict(v) for q, v in found(se.word_search(frame, ask(spark, texts, k=1000), stemmed=True)).items()}
    for q, t in enumerate(texts):
        match = " OR ".join(f'"{w}"' for w in t.split())
        want = {i - 1: round(-s, 9) for i, s in db.execute("SELECT rowid, bm25(t, 2.0, 1.0) FROM t WHERE t MATCH ?", (match,))}
        assert got.get(q, {}).keys() == want.keys(), t
        assert all(abs(got[q][i] - s) < 2e-9 for i, s in want.items()), t


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "generalizations": "gener", "deploy": "deploi", "deployment": "deploy", "is": "is", "as": "as", "sky": "sky", "happy": "happi", "agreed": "agre", "ies": "i", "filing": "file", "falling": "fall"}
    got = {w: stem(w) for w in want}
    assert {w: g for w, g in got.items() if w != "ies"} == {w: g for w, g in want.items() if w != "ies"} and got["ies"] in ("i", "ie")


def test_source_filter_leaves_statistics(spark, chunks):
    all_, some = ask(spark, ["deploy smoke"]), ask(spark, ["deploy smoke"], source="source/2")
    one = found(se.word_search(chunks, all_, stemmed=True))[0]
    assert found(se.word_search(chunks, some, stemmed=True)) == {0: [x for x in one if x[0] == 2]}


def test_cascade(spark, chunks):
    docs = spark.createDataFrame([(i, t + " " + c) for i, t, c in ROWS], "doc_id long, text string")
    got = se.cascade(chunks, ask(spark, ["deploy", "vascr", "javscript", "zzzzzz"]), fz.vocabulary(docs)).collect()
    assert {(r.query_id, r.layer, r.source_id, r.corrected) for r in got} == {(0, "word", 1, None), (1, "substring", 5, None), (2, "fuzzy", 5, "javascript")}
    hidden = se.cascade(chunks, ask(spark, ["deploy"], source="nowhere"), fz.vocabulary(docs)).collect()
    assert hidden == []


def model_correct(query, vocabulary, most=500):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    out, changed = [], False
    for w in [w for w in query.split() if len(w) >= 3]:
        bound = 1 if len(w) <= 4 else 2 if len(w) <= 12 else 3
        best, least = w, bound + 1
        for c in [v for v in vocabulary if abs(len(v) - len(w)) <= bound][:most]:
            d = distance(w.lower(), c.lower())
            if d < least:
                best, least = c, d
        out.append(best)
        changed |= best != w
    return " ".join(out) if changed else None


@pytest.mark.parametrize("most", [500, 5, None])
def test_correct(spark, most):
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(3, 14))) for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 10 : i * 10 + 10])) for i in range(12)], "doc_id long, text string")
    vocabulary = list(dict.fromkeys(words))
    queries = [r.choice(words)[:-1] + r.choice(["", "x", "abc"]) + " " + r.choice(words).upper() + " ab" for _ in range(40)] + [words[0], "ab", ""]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = dict(fz.correct(frame, fz.vocabulary(docs), most).collect())
    assert got == {i: c for i, q in enumerate(queries) if (c := model_correct(q, vocabulary, most)) is not None}


def test_vocabulary(spark):
    docs = spark.createDataFrame([(2, "Beta the alpha_x beta"), (1, "gamma-ray of Beta"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in fz.vocabulary(docs).orderBy("first_doc", "first_pos").collect()][0][:2] == ("gamma-ray", 1)
    assert {r.word for r in fz.vocabulary(docs).collect()} == {"gamma-ray", "beta", "alpha_x"}
    assert [r.word for r in fz.vocabulary(docs, most=2).collect()] == ["gamma-ray", "beta"]


def test_sanitize(spark):
    df = spark.createDataFrame([("not ('a b') OR near:cat* x",), ("###",), ("",), ("Android and",)], "q string")
    assert [r[0] for r in df.select(se.match_expression(F.col("q"))).collect()] == ['"cat"', '"###"', "", '"Android"']


def model_snippet(marked, most=1500, reach=300):
    clean, positions = "", []
    for c in marked:
        if c == "\x02":
            positions.append(len(clean))
        elif c != "\x03":
            clean += c
    if not positions or len(clean) <= most:
        return clean
    merged = []
    for p in sorted(positions):
        a, b = max(0, p - reach), min(len(clean), p + reach)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    parts, total = [], 0
    for a, b in merged:
        if total + b - a > most:
            break
        parts.append((a, b))
        total += b - a
    out = []
    for i, (a, b) in enumerate(parts):
        out.append(("…" if i == 0 and a > 0 else "") + clean[a:b] + ("…" if i < len(parts) - 1 or b < len(clean) else ""))
    return "\n\n".join(out)


def test_snippets(spark):
    import random

    r = random.Random(4)
    hit = "\x02hit\x03"
    texts = ["f" * 500 + hit + "g" * 800 + hit + "h" * 500, "f" * 2000, hit + "a", "a" * 1600 + hit, hit + "a" * 1600, (hit + "b" * 100) * 30, ""]
    for _ in range(40):
        texts.append("".join(r.choice([hit, "x" * r.randint(0, 700)]) for _ in range(r.randint(1, 12))))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    for row in df.select("i", sn.snippet(F.col("t")).alias("s"), sn.marker_positions(F.col("t")).alias("p")).collect():
        assert row.s == model_snippet(texts[row.i])
    assert sorted(df.filter("i = 0").select(sn.marker_positions(F.col("t"))).first()[0]) == [500, 1303]


def test_hit_positions(spark, chunks):
    queries = ask(spark, ["quasar_token naive", "deploying"])
    hits = se.word_search(chunks, queries, stemmed=True)
    got = {(r.query_id, r.source_id): r.positions for r in sn.hit_positions(hits, queries, stemmed=True).collect()}
    content = dict((i, c) for i, _, c in ROWS)
    assert got[(0, 4)] == [content[4].index("quasar"), content[4].index("naïve")]
    assert got[(1, 1)] == [0, content[1].rindex("deploy")]
    assert sn.with_snippets(hits, queries, stemmed=True).filter("query_id = 1").first().snippet == content[1]


def marks_of(words, texts):
    """Offsets of marks as an embedded engine sets them, where it leaves the text whole: its marks of overlapping matches repeat text."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", list(enumerate(texts)))
    match = " OR ".join(f'"{w}"' for w in words)
    out = {}
    for i, marked in db.execute("SELECT rowid, highlight(t, 0, char(2), char(3)) FROM t WHERE t MATCH ?", (match,)):
        clean, out[i] = 0, []
        for c in marked:
            if c == "\x02":
                out[i].append(clean)
            clean += c not in "\x02\x03"
        if marked.replace("\x02", "").replace("\x03", "") != texts[i]:
            del out[i]
    return out


def merged_marks(words, text):
    """Where stretches of overlapping matches begin."""
    low, out, until = text.lower(), [], 0
    for i in range(len(low)):
        reach = max((len(w) for w in words if low.startswith(w, i)), default=0)
        if reach and i >= until:
            out.append(i)
        until = max(until, i + reach) if reach else until
    return out


def test_substring_marks_against_engine(spark):
    import random

    r = random.Random(8)
    texts = ["".join(r.choices(["ab", "b", "a", "c", " ", "É", "é", "AB", "."], k=r.randint(3, 60))) for _ in range(60)] + ["aaaa", "abcabc", ".\\E(x", "xab"]
    for words in (["abab"], ["aba", "bab"], ["aaa"], ["abc", "cab", "é a"], ["aab", "aabc"], ["b.a", "\\e("]):
        df = spark.createDataFrame([(i, t, words) for i, t in enumerate(texts)], "i int, t string, w array<string>")
        got = {x.i: x.m for x in df.select("i", sn.substring_marks(F.col("t"), F.col("w")).alias("m")).collect() if x.m}
        assert got == {i: m for i, t in enumerate(texts) if (m := merged_marks(words, t))}, words
        same = marks_of(words, texts)
        assert same and {i: got[i] for i in same} == same, words


def test_substring_marks_where_lower_case_is_longer(spark):
    df = spark.createDataFrame([("\u0130\u0130 xabc \u0130abc", ["abc"]), ("\u0130abc", ["i\u0307a"]), ("", ["abc"]), ("abc", [])], "t string, w array<string>")
    assert [x[0] for x in df.select(sn.substring_marks(F.col("t"), F.col("w"))).collect()] == [[4, 9], [0], [], []]


def test_terms(spark):
    texts = ["alpha beta snake_case one", "alpha beta snake_case two", "alpha gamma extraordinarily", "delta the and gamma extraordinarily"]
    frame = spark.createDataFrame([(1 + i // 2, i % 2, "s", "t", t) for i, t in enumerate(texts)], "source_id long, chunk_ord int, label string, title string, content string")
    got = [(r["rank"], r.word, r.df, round(r.score, 6)) for r in te.distinctive_terms(frame).orderBy("rank").collect()]
    ln = lambda df: math.log(4 / df)
    want = [("snake_case", 2, ln(2) + 0.5 + 1.5), ("extraordinarily", 2, ln(2) + 0.5 + 0.8), ("alpha", 3, ln(3) + 0.25), ("gamma", 2, ln(2) + 0.25), ("beta", 2, ln(2) + 0.2)]
    want.sort(key=lambda x: -x[2])
    assert got == [(i + 1, w, d, round(s, 6)) for i, (w, d, s) in enumerate(want)]
    by = {(r.source_id, r.word) for r in te.distinctive_terms(frame, by_source=True).collect()}
    assert (1, "snake_case") in by and (1, "gamma") not in by
