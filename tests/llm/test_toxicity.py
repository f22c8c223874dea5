"""The pattern grammar on clauses, learning on planted insults, held-out accuracy."""

import random
import zlib

import pytest

import lodestone.llm.toxicity as m


def kinds(text, lexicon=("idiot", "vermin", "loath*")):
    found = m.Model(dict.fromkeys(lexicon, 2.0)).kinds(text)
    return {k: v for k, v in zip(m.KINDS, found.tolist(), strict=True) if v}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("what an idiot there", {"insult": 2.0}),
        ("You are an idiot. You idiot!", {"aimed insult": 4.0}),
        ("idiot, you", {"aimed insult": 2.0}),
        ("he is not an idiot", {"negated": 2.0}),
        ("it is not at all that some idiot came", {"insult": 2.0}),
        ("someone said the word idiot. idiot", {"reported": 2.0, "insult": 2.0}),
        ("we will kill you", {"aimed threat": 1.0}),
        ("kill time", {"threat": 1.0}),
        ("never kill", {"negated": 1.0}),
        ("LOATHSOMELY odd; an idiot and vermin", {"insult": 4.0}),
        ("nothing here", {}),
        ("", {}),
        ("idiotic", {}),
    ],
)
def test_clauses(text, want):
    assert kinds(text) == want


def test_composition_is_one_after_the_other():
    r = random.Random(2)
    whole, parts = m.grammar(), (m.negation(), m.reporting(), m.aiming())
    for _ in range(300):
        string = [r.choice(m.CLASSES) for _ in range(r.randint(0, 15))]
        state, got = whole.start, []
        for x in string:
            state, y = whole.move(state, x)
            got.append(y)
        want = string
        for t in parts:
            state, out = t.start, []
            for x in want:
                state, y = t.move(state, x)
                out.append(y)
            want = out
        assert got == want


def test_learning(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    docs, labels = [(100_000, None, "x"), (100_001, "", "x"), (None, "you zonko", "x")], [(100_000, 1), (None, 1), (5, None)]
    for i in range(1500):
        toxic = r.random() < 0.12
        words = [word() for _ in range(r.randint(5, 60))]
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["zonko", "flurb", "quargle" + word()]))
        docs.append((i, " ".join(words), "score"))
        if r.random() < 0.7:
            labels.append((i, int(toxic)))
    labels += labels[50:60]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = m.learn(frame, marks)
    assert {"zonko", "flurb", "quarg*"} <= set(model.lexicon) and len(set(model.lexicon) - set(m.INSULT.split())) < 8
    got = m.score(frame, model).collect()
    assert len(got) == len(docs)
    truth = {d: any(w in (t or "") for w in ("zonko", "flurb", "quargle")) for d, t, _ in docs}
    for g in got:
        assert g.predicted == int(g.score >= 0.5) and 0 <= g.score <= 1
        assert g.held_out == (None if g.doc_id is None else zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
    right = sum(g.predicted == truth[g.doc_id] for g in got)
    assert right >= len(got) - 3
    left = m.without_toxic(frame, model)
    assert left.columns == frame.columns and left.count() == sum(1 - g.predicted for g in got)


def test_only_copies_are_merged(spark):
    r = random.Random(6)
    common = ["amber", "basil", "cedar", "delta", "ember", "fjord", "grove", "hazel", "inlet", "jetty", "knoll", "larch"]
    rows = []
    for i in range(400):
        words = r.sample(common, r.randint(4, 8)) + (["zonko"] if i % 4 == 0 else [])
        r.shuffle(words)
        rows.append((" ".join(words), int(i % 4 == 0)))
    rows += [("Mauve shard plinth, zither.", 1), ("zither plinth shard mauve", 1)] * 30  # copies are one witness
    lexicon = m._lexicon(spark.createDataFrame(rows, "text string, toxic int").repartition(4))
    assert "zonko" in lexicon and not set(lexicon) & {"mauve", "shard", "plinth", "zither", *common}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = m.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.lexicon == dict.fromkeys(m.INSULT.split(), m.SEED_WEIGHT) and m.score(none, model).collect() == []
    only = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    assert {r.predicted for r in m.score(only, model).collect()} == {0}
