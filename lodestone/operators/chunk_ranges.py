"""The markdown chunker for texts of any length: lines in ranges, a summary for each range, and one carry over the summaries.

A text comes as rows (doc_id, part, nth, line): ranges of lines, ``part`` after ``part``, ``nth`` after ``nth``. What a line is depends on all lines
before it in three ways only, each of which a range sums up in a few numbers:

* whether a fence is open: the number of fence lines, as each opens or closes;
* which section it is in: the number of headings and separators outside fences;
* the path of headings: how far a range cuts it and what it then appends, of four entries at most, for each length that it can come in with.

The carry reads one row for each range. Lines are counted inside their own range, so no task has a whole text, except for what is
one section, whose content is one value of the result. Each text has a doc_id of its own, not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import js_trim
from lodestone.operators.chunk import FENCE, HEADING, SEPARATOR
from lodestone.sources.shared import stored

RANGE = ["doc_id", "part"]
#: Sections that are numbered together.
SPAN = 4096


def line_ranges(docs: DataFrame, size: int = 10_000) -> DataFrame:
    """The lines of texts (doc_id, text) in ranges of ``size``."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("nth", "line"))
    return each.select("doc_id", F.floor(F.col("nth") / size).cast("long").alias("part"), F.col("nth").cast("long").alias("nth"), "line")


def file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files, each split of a file a range: a large file is read by many tasks. Its doc_id is a hash of its path.

    A line break at the end of a file begins no further line here; it makes no chunk either.
    """
    return spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))


def _carried(per_range: DataFrame, column: str) -> DataFrame:
    """The sum of a column over the ranges before; there is one row for each range."""
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.withColumn(column, F.coalesce(F.sum(column).over(before), F.lit(0)))


def _pushed(path: Column, level: Column, title: Column) -> Column:
    """The path after a heading: cut to what is above its level, by depth, and the heading appended. A separator, of level 0, leaves it."""
    return F.when(level == 0, path).otherwise(F.concat(F.slice(path, F.lit(1), F.greatest(F.least(F.size(path), level - 1), F.lit(0))), F.array(title)))


def marked_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with section (the headings and separators up to the line), kind (fence, heading, separator or none), level and title. Stored."""
    inside, fence = Window.partitionBy(*RANGE).orderBy("nth"), F.col("line").startswith(FENCE)
    opened = _carried(lines.groupBy(*RANGE).agg(F.count_if(fence).alias("fences")), "fences")
    count = F.sum(F.col("fence").cast("int")).over(inside)
    seen = lines.withColumn("fence", fence).join(opened, RANGE).withColumn("open", (F.col("fences") + count - F.col("fence").cast("int")) % 2 == 1)
    free = ~F.col("fence") & ~F.col("open")
    kind = F.when(F.col("fence"), "fence").when(free & F.col("line").rlike(SEPARATOR), "separator").when(free & F.col("line").rlike(HEADING), "heading")
    level = F.when(F.col("kind") == "heading", F.char_length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    kinds = seen.withColumn("kind", kind).withColumns({"level": level, "title": js_trim(F.regexp_extract("line", HEADING, 2)), "event": F.coalesce(F.col("kind").isin("heading", "separator"), F.lit(False)).cast("int")})
    kinds = stored(kinds.withColumn("own", F.sum("event").over(inside)).select(*RANGE, "nth", "line", "kind", "level", "title", "event", "own"), "marked-lines")
    earlier = _carried(kinds.groupBy(*RANGE).agg(F.sum("event").alias("events")), "events")
    return kinds.join(earlier, RANGE).withColumn("section", F.col("events") + F.col("own")).drop("events", "own")


def section_paths(marked: DataFrame) -> DataFrame:
    """doc_id, section, path: the path of headings that each section begins with."""
    events = marked.filter("event = 1").groupBy(*RANGE).agg(F.sort_array(F.collect_list(F.struct("section", "level", "title"))).alias("events"))
    none, state = F.array().cast("array<string>"), "struct<cut:int,path:array<string>>"

    def summed(s: Column, e: Column) -> Column:
        """``cut`` entries of the path that comes in stay, then ``path`` follows."""
        kept = F.least(s["cut"] + F.size(s["path"]), e["level"] - 1)
        path = F.concat(F.slice(s["path"], F.lit(1), F.greatest(kept - s["cut"], F.lit(0))), F.array(e["title"]))
        return F.when(e["level"] == 0, s).otherwise(F.struct(F.least(s["cut"], kept).cast("int").alias("cut"), path.alias("path")).cast(state))

    starts = F.sequence(F.lit(0), F.lit(4))
    does = F.transform(starts, lambda d: F.aggregate("events", F.struct(d.cast("int").alias("cut"), none.alias("path")).cast(state), summed))
    ranges = events.select(*RANGE, "events", does.alias("does"))
    listed = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "does"))).alias("all"))  # one small row for each range

    def after(s: Column, x: Column) -> Column:
        does = F.get(x["does"], F.size(s["path"]))
        path = F.concat(F.slice(s["path"], F.lit(1), does["cut"]), does["path"])
        return F.struct(path.alias("path"), F.concat(s["out"], F.array(F.struct(x["part"].alias("part"), s["path"].alias("before")))).alias("out")).cast("struct<path:array<string>,out:array<struct<part:bigint,before:array<string>>>>")

    zero = F.from_json(F.lit('{"path":[],"out":[]}'), "struct<path:array<string>,out:array<struct<part:bigint,before:array<string>>>>")
    befores = listed.select("doc_id", F.explode(F.aggregate("all", zero, after, lambda s: s["out"])).alias("x")).select("doc_id", "x.part", "x.before")

    def walked(s: Column, e: Column) -> Column:
        path = _pushed(s["path"], e["level"], e["title"])
        return F.struct(path.alias("path"), F.concat(s["out"], F.array(F.struct(e["section"].alias("section"), path.alias("path")))).alias("out")).cast("struct<path:array<string>,out:array<struct<section:bigint,path:array<string>>>>")

    begin = F.struct(F.col("before").alias("path"), F.from_json(F.lit("[]"), "array<struct<section:bigint,path:array<string>>>").alias("out")).cast("struct<path:array<string>,out:array<struct<section:bigint,path:array<string>>>>")
    met = ranges.drop("does").join(befores, RANGE)
    first = marked.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("section"), none.alias("path"))
    return met.select("doc_id", F.explode(F.aggregate("events", begin, walked, lambda s: s["out"])).alias("x")).select("doc_id", "x.section", "x.path").unionByName(first)


def markdown_ranges(lines: DataFrame) -> DataFrame:
    """doc_id, chunk_ord, title, content, has_code: ``markdown_chunks`` of each text of ``lines``. Chunks are numbered from the first section that has any content."""
    marked = marked_lines(lines)
    order = F.sort_array(F.collect_list(F.when(F.coalesce(F.col("kind"), F.lit("")) != "separator", F.struct("part", "nth", "line"))))
    text = js_trim(F.array_join(F.transform(order, lambda x: x["line"]), "\n"))
    sections = marked.groupBy("doc_id", "section").agg(text.alias("content"), F.max(F.coalesce(F.col("kind") == "fence", F.lit(False))).alias("has_code")).filter("content != ''")
    named = sections.join(section_paths(marked), ["doc_id", "section"])
    title = F.when(F.size("path") > 0, F.array_join("path", " > ")).otherwise(F.substring("content", 1, 80))
    span = F.floor(F.col("section") / SPAN).cast("long").alias("part")
    earlier = _carried(sections.groupBy("doc_id", span).agg(F.count(F.lit(1)).alias("chunks")), "chunks")
    number = F.col("chunks") + F.row_number().over(Window.partitionBy(*RANGE).orderBy("section")) - 1
    return named.withColumn("part", span).join(earlier, RANGE).select("doc_id", number.cast("int").alias("chunk_ord"), title.alias("title"), "content", "has_code")
