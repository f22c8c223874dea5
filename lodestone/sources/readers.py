"""Text sources as (doc_id, source, text) tables. All sizes are bytes; what is over the limit is not indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.html import html_to_markdown
from lodestone.operators.predicates import SOURCE_BYTES, is_fetchable

FETCH_CHARS = 10 * 1024 * 1024


def inline(df: DataFrame, most: int = SOURCE_BYTES) -> DataFrame:
    """Rows whose text is given (not null, not empty) and within the limit."""
    return df.filter((F.octet_length("text") > 0) & (F.octet_length("text") <= most))


def files(spark: SparkSession, path: str, label: str | None = None, most: int = SOURCE_BYTES) -> DataFrame:
    """Whole UTF-8 files; the label is the path unless given. The size is checked before the content is read."""
    found = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)
    return found.select(F.xxhash64("path").alias("doc_id"), (F.lit(label) if label else F.col("path")).alias("source"), F.decode("content", "UTF-8").alias("text"))


def fetched(pages: DataFrame, most: int = FETCH_CHARS) -> DataFrame:
    """Pages (page_id, url, html) that may be fetched, as markdown; the label is the URL."""
    usable = pages.filter(is_fetchable(F.col("url")) & (F.char_length("html") <= most))
    return usable.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), html_to_markdown(F.col("html")).alias("text"))
