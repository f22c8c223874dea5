"""Markdown by ranges of lines against the chunker of whole texts."""

import random

from pyspark.sql import functions as F

from lodestone.operators import chunk_ranges as cr
from lodestone.operators.chunk import markdown_chunks

LINES = ["# A", "## B", "### C", "#### D", "##### not", "## B two  ", "text", "more text", "", "  ", "---", "***", "-*_ ", "```", "```py", "``` # x", "# in code?", "#no", "é"]


def texts(n):
    r = random.Random(4)
    made = ["\n".join(r.choices(LINES, k=r.randint(1, 60))) for _ in range(n)]
    return [*made, "", "### deep\n# top\n#### under\n## next", "```\n# never closed\n---\nx", "a", "\n\n", "# only"]


def whole(df):
    c = df.select("doc_id", F.posexplode(markdown_chunks(F.col("text"))).alias("i", "c"))
    return sorted((r.doc_id, r.i, r.c.title, r.c.content, r.c.has_code) for r in c.collect())


def ranges(lines):
    return sorted((r.doc_id, r.chunk_ord, r.title, r.content, r.has_code) for r in cr.markdown_ranges(lines).collect())


def test_cut_at_any_line(spark, monkeypatch):
    monkeypatch.setattr(cr, "SPAN", 3)
    docs = spark.createDataFrame(list(enumerate(texts(60))), "doc_id long, text string")
    want = whole(docs)
    for size in (1, 2, 3, 7, 1000):
        assert ranges(cr.line_ranges(docs, size).repartition(5)) == want, size


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    text = "\n".join(random.Random(9).choices(LINES, k=4000))
    (tmp_path / "a.md").write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = cr.file_ranges(spark, str(tmp_path / "a.md"))
        assert lines.select("part").distinct().count() > 8
        got = [x[1:] for x in ranges(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [x[1:] for x in whole(spark.createDataFrame([(0, text)], "doc_id long, text string"))]
