"""The pipeline on the small tables: each stage against what its input asks for."""

import re
from collections import Counter

import corpus_pipeline
from lodestone.llm._common import read_table, stored
from lodestone.llm.decontamination import normal
from tests_llm_helpers import near_dup_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), name))
    rows = [k.collect() for k in kept]
    assert all(k.columns == columns for k in kept[:-1])
    labels = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    left = {r.doc_id for r in rows[1]}
    known = [d for d in labels if d in {r.doc_id for r in rows[0]}]
    gone = [d for d in known if d not in left]
    assert gone and all(labels[d] == 1 for d in gone)
    want = near_dup_brute([(r.doc_id, r.text) for r in rows[1]], 5, 80)
    assert {r.doc_id for r in rows[2]} == want
    items = [normal(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    for r in rows[2]:
        if any(i in normal(r.text or "") for i in items):
            assert r.doc_id not in {x.doc_id for x in rows[3]}
    assert len(rows[3]) >= 0.9 * len(rows[2])
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]} and max(Counter(r.doc_id for r in rows[4]).values()) <= 2
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rs)
    assert abs(words(rows[4]) - 1.5 * words(rows[3])) < 0.1 * words(rows[3])
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
    assert corpus_pipeline.run(spark, SF).count() == len(rows[5])
