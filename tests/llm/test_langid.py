"""Cross-parsing against a plain greedy parse, and held-out accuracy on the documents table."""

import random
import zlib

import lodestone.llm.langid as m
from lodestone.llm._common import read_table


def test_automaton_accepts_all_substrings_only():
    r = random.Random(1)
    s = [r.randrange(3) for _ in range(60)]
    subs = {tuple(s[i:j]) for i in range(60) for j in range(i, 61)}
    steps = m.suffix_automaton(s)

    def accepts(w):
        at = 0
        for c in w:
            if c not in steps[at]:
                return False
            at = steps[at][c]
        return True

    assert all(accepts(w) for w in subs)
    for _ in range(2000):
        w = tuple(r.randrange(3) for _ in range(r.randint(1, 9)))
        assert accepts(w) == (w in subs)


def test_phrases(monkeypatch):
    r = random.Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 7)))
    samples = [("aa", " ".join(word("abcde") for _ in range(40))), ("bb", " ".join(word("abxyz") for _ in range(50))), ("bb", "more ß")]
    p = m.Parser(samples)
    refs = {g: p.symbols(" ".join(t for own, t in sorted(samples) if own == g)).tolist() for g in p.langs}
    text_of = lambda seq: "".join(chr(97 + c) for c in seq)
    texts = [p.symbols(" ".join(word("abcdexyzqé\U0001f600") for _ in range(r.randint(1, 60)))) for _ in range(20)]
    monkeypatch.setattr(m, "PIECE", 4096)
    got = p.phrases(texts)
    for row, t in zip(got.tolist(), texts, strict=True):
        for g, n in zip(p.langs, row, strict=True):
            ref, rest, count = text_of(refs[g]), text_of(t.tolist()), 0
            while rest:  # a phrase counts when the next one begins, or if it is one unknown symbol
                k = next((k for k in range(len(rest), 0, -1) if rest[:k] in ref), 0)
                if k == len(rest):
                    break
                count += 1
                rest = rest[k or 1 :]
            assert abs(n - count) <= 1 + sum(c not in ref for c in text_of(t.tolist()))


def test_displaced_holds_all_transitions(monkeypatch):
    r = random.Random(3)
    steps = m.suffix_automaton([r.randrange(40) for _ in range(400)])
    for tries in (200, 1):  # with one try most states are put at the end
        monkeypatch.setattr(m, "TRIES", tries)
        entries, offsets = m.displaced(steps, 40)
        assert len(set(offsets.tolist())) == len(steps)
        for state, moves in enumerate(steps):
            for c in range(40):
                found = int(entries[offsets[state] + c])
                assert (found & 0xFFFFFFFF if found >> 32 == offsets[state] else None) == (offsets[moves[c]] if c in moves else None)


def test_scripts_with_many_letters():
    r = random.Random(5)
    scripts = {"el": 0x3B1, "ru": 0x430, "ar": 0x627, "ja": 0x3041, "ko": 0xAC00, "zh1": 0x4E00, "zh2": 0x5E00, "am": 0x1200}
    word = lambda g: "".join(chr(scripts[g] + r.randrange(20 if g in ("el", "ru", "ar") else 80)) for _ in range(3))
    lines = lambda g: " ".join(word(g) for _ in range(60))
    p = m.Parser([(g, lines(g)) for g in scripts for _ in range(10)])
    assert [a[0] for a in p.predict([lines(g) for g in scripts])] == list(scripts)


def test_all_languages_are_learned(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + 9 * k) * 3} {chr(0x4E01 + 9 * k) * 2} ", f"x{k:02}") for k in range(80) for i in range(8)]
    rows += [(100_000 + i, "more of the most frequent", "x00") for i in range(500)]
    got = m.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    truth = {d: g for d, _, g in rows}
    assert len(got) == len(rows) and all(g.lang_pred == truth[g.doc_id] for g in got)


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = m.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) and 0 <= g.score <= 1 for g in got)
    tested = [g for g in got if g.held_out and truth[g.doc_id][0] is not None]
    right = sum(g.lang_pred == truth[g.doc_id][0] for g in tested)
    assert right >= 0.97 * len(tested), (right, len(tested))


def test_cases(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", ""), (2, "", "en", ""), (3, "123 !? \n", "en", ""), (None, "der die das und", "de", ""), (4, "日本語", None, ""), (4, "日本語", None, "")]
    rows += [(10 + i, "the and of to in that is was" if i % 2 else "der die das und ist nicht ein", "en" if i % 2 else "de", "") for i in range(40)]
    got = m.identify(spark.createDataFrame(rows, schema).repartition(3)).collect()
    by = {}
    for g in got:
        by.setdefault(g.doc_id, []).append(g)
    assert [by[i][0].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1][0].score == 0
    assert by[None][0].lang_pred == "de" and by[None][0].held_out is None and len(by[4]) == 2
    assert all(by[10 + i][0].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    unlabelled = spark.createDataFrame([(1, "text", None, "")], schema)
    assert [r.lang_pred for r in m.identify(unlabelled).collect()] == ["und"]
    assert m.identify(spark.createDataFrame([], schema)).collect() == []
