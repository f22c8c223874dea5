"""Token shards: exact ids, exact round trips, random access."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import token_output as m

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


TEXTS = [
    None, "", " ", "\n\t ", "Hello, world. it's 'tis don't THE the The", "Élan naïve Straße ßÄÖ café café İstanbul ΣΑΣ", "a\x1cb c\x85d e\xa0f 　 x​y", "...,, --__ a_b (par) \"q\" 'z' it's, dogs' 12 3a4b",
    "<|endoftext|> x<|startoftext|>y", "日本語 한글 \U0001f600 ok\U0001f600", "no break", "x" * 5000, "the " * 300, "of,the;cat 'the ’s we'll",
]


def test_ids_match_the_tokenizer():
    coder = m.WordTokenizer(PATH)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[3:9]):
        ids, counts = coder.encode(pa.array(texts, pa.string()))
        want = reference(texts)
        assert ids.tolist() == [i for d in want for i in d] and counts.tolist() == [len(d) for d in want]


def test_forgetting_keeps_results(monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 10)
    coder = m.WordTokenizer(PATH)
    r = random.Random(1)
    for _ in range(20):
        texts = [" ".join(r.choice(["the", "cat", "Élan", "x.y", f"w{r.randint(0, 99)}"]) for _ in range(30)) for _ in range(4)]
        assert coder.encode(pa.array(texts))[0].tolist() == [i for d in reference(texts) for i in d]


@pytest.mark.parametrize("least", [10**9, 24, 3])
def test_shard_round_trip(least):
    r = np.random.default_rng(3)
    docs = [np.append(np.tile(r.integers(0, 40, r.integers(1, 30)), r.integers(0, 50)), 1) for _ in range(60)] + [np.array([1]), np.full(2000, 7)]
    ids = np.concatenate(docs).astype(np.uint16)
    names = [None, *range(1, len(docs))]
    shard = m.Shard(m.pack(ids, np.array([len(d) for d in docs]), names, 50, least))
    assert shard.ids().tolist() == ids.tolist() and shard.doc_ids == names
    assert (len(shard.rules) > 0) == (least < 10**9)
    symbols = shard.symbols.tolist()
    left = Counter(p for p in zip(symbols, symbols[1:]) if 1 not in p)
    # No frequent pair is left, but that a run of one symbol may count its overlaps.
    assert all(n < least or (a == b and n < 2 * least) for (a, b), n in left.items())
    assert shard.lengths[50:].tolist() == [len(shard._expand(np.array([50 + i]))) for i in range(len(shard.rules))]
    for start, n in ((0, 1), (5, 100), (len(ids) - 3, 3), (17, 0)):
        assert shard.read_ids(start, n).tolist() == ids[start : start + n].tolist()
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d.tolist()


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    rows = [(7 * i % 23 if i != 5 else None, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, "twice", "y", 0), (3, "twice", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int").repartition(3)
    got = m.token_output(docs, PATH, str(tmp_path / "shards")).orderBy("start").collect()
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    for g, row, want in zip(got, rows, reference([x[1] for x in rows]), strict=True):
        assert tuple(g) == (row[0], at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert m.token_output(docs.limit(0), PATH).collect() == []


def test_16_bit_symbols_run_out(monkeypatch):
    monkeypatch.setattr(m, "MOST_SYMBOLS", 60)
    ids = np.tile(np.arange(2, 40), 200).astype(np.uint16)
    rules, lengths, seq = m.compress(ids, 50, 3)
    assert len(rules) == 10 and m.Shard(m.pack(ids, np.array([len(ids)]), [1], 50, 3)).ids().tolist() == ids.tolist()
    monkeypatch.setattr(m, "MOST_SYMBOLS", 1000)
    with pytest.raises(ValueError, match="16-bit"):
        m.WordTokenizer(PATH)


def test_rounds_end_with_pairs_that_overlap_themselves():
    """Re-Pair's own threshold, two: no pair occurs twice apart in what is left, within documents."""
    rng = random.Random(6)
    cases = [[5, 5, 5, 1], [5, 5, 5, 1, 5, 1], [5] * 9 + [1], [7, 7, 7, 8, 7, 7, 7, 8, 1], *([rng.randint(2, 4) for _ in range(rng.randint(2, 60))] + [1] for _ in range(200))]
    for ids in cases:
        rules, lengths, seq = m.compress(np.array(ids, np.uint32), 10, min_count=2)
        spelt = [[i] for i in range(10)]
        for a, b in rules:
            spelt.append(spelt[a] + spelt[b])
        assert [t for s in seq for t in spelt[s]] == ids and [len(s) for s in spelt[10:]] == lengths.tolist()
        left, places = seq.tolist(), {}
        for i in range(len(left) - 1):
            if m.END_ID not in left[i : i + 2]:
                places.setdefault((left[i], left[i + 1]), []).append(i)
        assert not any(x[-1] - x[0] > 1 for x in places.values()), ids
