"""Words are counted without sorting them, as a place is one number."""

from decimal import Decimal

from pyspark.sql import functions as F

from lodestone.functions.text import place, place_parts
from lodestone.operators import fuzzy as fz
from lodestone.operators import terms as te
from lodestone.operators.chunk import chunk

DOCS = "doc_id long, source string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_without_sorting_them(spark):
    docs = spark.createDataFrame([(None, "a", "alpha beta"), (-(1 << 63), "a", "beta gamma"), (7, "a", "gamma delta")], DOCS)
    words = fz.vocabulary(docs)
    assert "SortAggregate" not in plan(words) and "SortAggregate" not in plan(te.document_frequency(chunk(docs)))
    assert {tuple(r) for r in words.collect()} == {("alpha", None, 0), ("beta", None, 1), ("gamma", -(1 << 63), 1), ("delta", 7, 1)}
    assert "SortAggregate" not in plan(te.distinctive_terms(chunk(docs), by_source=True))


def test_places_keep_order_and_come_apart(spark):
    most, least = (1 << 63) - 1, -(1 << 63)
    rows = [(None, 0), (None, 5), (least, 0), (least, (1 << 31) - 1), (-1, 3), (0, 0), (0, 1), (most, (1 << 31) - 1)]
    df = spark.createDataFrame(rows, "doc long, pos int").withColumn("at", place(F.col("doc"), F.col("pos")))
    doc, pos = place_parts(F.col("at"))
    assert [tuple(r) for r in df.orderBy("at").select(doc, pos).collect()] == rows
    three = spark.createDataFrame([(most, (1 << 31) - 1)], "a long, b int").select(place(F.col("a"), F.col("b"), F.col("b"))).first()[0]
    assert three == Decimal((1 << 125) - 1)
