"""Vocabulary and spelling correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import place, place_parts, vocabulary_words


def vocabulary(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int | None = None, sample_chars: int | None = None) -> DataFrame:
    """word and where it is first seen (first_doc, first_pos), optionally the first ``most`` words only.

    The order of first sight is the key pair itself, so no global numbering is needed; with ``most`` it is one top-k.
    """
    source = F.col(text) if sample_chars is None else F.substring(text, 1, sample_chars)
    kind = docs.schema[doc].dataType.simpleString()
    each = docs.select(F.col(doc).alias("doc"), F.posexplode(vocabulary_words(source)).alias("pos", "word"))
    if kind in ("tinyint", "smallint", "int", "bigint"):  # a pair would be aggregated by sorting all words
        at = each.groupBy("word").agg(F.min(place(F.col("doc"), F.col("pos"))).alias("first"))
        first_doc, first_pos = place_parts(F.col("first"))
        words = at.select("word", first_doc.cast(kind).alias("first_doc"), first_pos.alias("first_pos"))
    else:
        words = each.groupBy("word").agg(F.min(F.struct("doc", "pos")).alias("first")).select("word", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    return words if most is None else words.orderBy("first_doc", "first_pos").limit(most)


def _cut(size: Column, pieces: Column, i: Column) -> Column:
    """Where piece ``i`` of a word cut evenly begins."""
    return F.floor(i * size / pieces).cast("int")


def near_by_pieces(spread: DataFrame, words: DataFrame) -> DataFrame:
    """(w, bound, size) of ``spread`` with those words of that size that can be within the bound, a word once or several times.

    A word cut into one piece more than the bound keeps a piece whole in anything within the bound of it, no further from its place than
    the bound. So words and queries meet by equal pieces and places: a word has one row for each piece, a query's word seven or fewer.
    """
    sized = words.withColumn("size", F.char_length("word"))
    own = F.col("i").cast("int")
    bounds = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda b: F.when(b == 1, F.col("size") <= 5).when(b == 2, F.col("size").between(3, 14)).otherwise(F.col("size") >= 10))
    cut = sized.withColumn("bound", F.explode(bounds)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bound"))))
    begin, end = _cut(F.col("size"), F.col("bound") + 1, own), _cut(F.col("size"), F.col("bound") + 1, own + 1)
    keyed = cut.withColumn("piece", F.substring(F.lower("word"), begin + 1, end - begin))
    places = spread.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bound")))).withColumn("shift", F.explode(F.sequence(-F.col("bound"), F.col("bound"))))
    part = F.substring(F.lower("w"), begin + F.col("shift") + 1, end - begin)
    asked = places.filter((begin + F.col("shift") >= 0) & (end + F.col("shift") <= F.char_length(F.lower("w")))).select("w", "bound", "size", "i", part.alias("piece")).distinct()
    return asked.join(keyed, ["bound", "size", "i", "piece"]).select("w", "bound", "size", "word", "first_doc", "first_pos")


def correct(queries: DataFrame, words: DataFrame, candidates: int | None = None) -> DataFrame:
    """query_id, corrected for the queries that correction changes.

    Words of under three characters go. Of the vocabulary, the word nearest within the bound wins (1, 2 or 3 edits for up to 4, up to 12
    and more characters), the earliest on ties. Compared are words of a length within the bound that share a piece with the word, as all
    within the bound do. With ``candidates``, a word has only the first so many of the lengths within its bound, in the order of the
    vocabulary. Lengths are joined by equality, one row for each length allowed.
    """
    raw = queries.select("query_id", F.posexplode(F.split("query", r"(?U)[\s﻿]+")).alias("ord", "w")).filter("char_length(w) >= 3")
    bound = F.when(F.char_length("w") <= 4, 1).when(F.char_length("w") <= 12, 2).otherwise(3)
    wanted = raw.withColumn("bound", bound)
    n = F.char_length("w")
    spread = wanted.select("w", "bound", F.explode(F.sequence(n - F.col("bound"), n + F.col("bound"))).alias("size")).distinct()
    if candidates is None:
        met = near_by_pieces(spread, words)
    else:  # the first of a band of lengths are among the first of each length
        sized = words.withColumn("size", F.char_length("word")).withColumn("nth", F.row_number().over(Window.partitionBy("size").orderBy("first_doc", "first_pos"))).filter(F.col("nth") <= candidates).drop("nth")
        met = spread.join(sized, "size").withColumn("nth", F.row_number().over(Window.partitionBy("w").orderBy("first_doc", "first_pos"))).filter(F.col("nth") <= candidates)
    distance = F.expr("levenshtein(lower(w), lower(word), bound)")
    near = met.withColumn("distance", distance).filter("distance >= 0")
    best = near.groupBy("w").agg(F.min_by("word", F.struct("distance", "first_doc", "first_pos")).alias("best"))
    done = wanted.join(best, "w", "left").withColumn("best", F.coalesce("best", "w"))
    joined = done.groupBy("query_id").agg(F.max(F.col("best") != F.col("w")).alias("changed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "best"))), lambda x: x["best"]), " ").alias("corrected"))
    return joined.filter("changed").select("query_id", "corrected")
