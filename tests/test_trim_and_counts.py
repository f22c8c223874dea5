"""Trimming without a pattern, and token counts from which stems and peaks are made."""

import time

from pyspark.sql import functions as F

from lodestone.functions.text import js_trim
from lodestone.operators import indexed as ix


def test_trim_takes_white_space_at_both_ends_only(spark):
    white = "\t\n\x0b\x0c\r \x85\xa0        　﻿"
    other = "​᠎\x1f\x00⁠"
    rows = [(x,) for x in ("", " ", "a", f" {white}a{white}b{white} ", *(f"{c}x{c}" for c in white + other), *(c for c in white + other), "😀 　", None)]
    df = spark.createDataFrame(rows, "t string")
    assert df.select(js_trim(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)\A[\s﻿]+|[\s﻿]+\z", "").alias("b")).filter("NOT a <=> b").count() == 0


def test_trim_of_a_long_run_inside_is_not_quadratic(spark):
    began = time.time()
    assert spark.range(1).select(F.length(js_trim(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 300_000), F.lit("b "))))).first()[0] == 300_002
    assert time.time() - began < 10  # a pattern tried at each space takes minutes


def test_stems_and_peaks_from_token_counts(spark, monkeypatch):
    monkeypatch.setattr(ix, "FREQUENT", 3)
    posted = spark.createDataFrame([(1, "running", i, 10 + i, float(i)) for i in range(4)] + [(1, "runs", 0, 5, 1.0)], "commit long, token string, cid long, dl int, weighted double")
    counted = ix.token_counts(posted)
    assert {tuple(r) for r in counted.collect()} == {("running", 4), ("runs", 1)}
    assert {tuple(r) for r in ix.stems(counted).collect()} == {("run", "running"), ("run", "runs")}
    assert [tuple(r) for r in ix.peaks(posted, counted).collect()] == [(1, "running", 0, 3.0, 10)]
