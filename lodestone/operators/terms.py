"""Term statistics: which words tell chunks apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import place, vocabulary_words
from lodestone.sources.shared import stored


def document_frequency(chunks: DataFrame, by_source: bool = False, first_chunks: int | None = None) -> DataFrame:
    """word, df: chunks that hold the word; by source if asked for, of each scope's first chunks only if limited."""
    scope = ["source_id"] if by_source else []
    if first_chunks is not None:
        if by_source:
            nth = F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_ord"))
            chunks = chunks.withColumn("nth", nth).filter(F.col("nth") <= first_chunks)
        else:
            chunks = chunks.orderBy("source_id", "chunk_ord").limit(first_chunks)
    return counted_words(chunks, scope).filter("word IS NOT NULL")


def counted_words(chunks: DataFrame, scope: list[str]) -> DataFrame:
    """word, df, first_seen by scope; the row whose word is null counts the chunks of the scope.

    ``first_seen`` is one number in the order of source, chunk and place, as a struct would be aggregated by sorting all words.
    """
    words = F.concat(F.array_distinct(vocabulary_words(F.coalesce("content", F.lit("")))), F.array(F.lit(None).cast("string")))
    each = chunks.select("source_id", "chunk_ord", F.posexplode(words).alias("pos", "word"))
    seen = F.shiftleft(F.col("chunk_ord").cast("long"), 32) + F.col("pos") if scope else place(F.col("source_id"), F.col("chunk_ord"), F.col("pos"))
    return each.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("df"), F.min(seen).alias("first_seen"))


def scored_terms(chunks: DataFrame, by_source: bool = False, first_chunks: int | None = None) -> DataFrame:
    """Words in two to 40 % of the chunks (three at least), with their score: rarity, length and identifier bonus."""
    if first_chunks is not None:
        df = document_frequency(chunks, by_source, first_chunks)
        size = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks")) if by_source else chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
        sized = df.join(size, "source_id") if by_source else df.crossJoin(F.broadcast(size))  # one row
    elif by_source:  # words and chunks are counted in one pass
        total = F.max(F.when(F.col("word").isNull(), F.col("df"))).over(Window.partitionBy("source_id"))
        sized = counted_words(chunks, ["source_id"]).withColumn("n_chunks", total).filter("source_id IS NOT NULL AND word IS NOT NULL")
    else:
        df = stored(counted_words(chunks, []), "word-counts")
        sized = df.filter("word IS NOT NULL").crossJoin(F.broadcast(df.filter("word IS NULL").select(F.col("df").alias("n_chunks"))))  # one row
    most = F.greatest(F.lit(3), F.ceil(F.col("n_chunks") * 0.4))
    n = F.char_length("word")
    bonus = F.when(F.col("word").contains("_"), 1.5).when(n >= 12, 0.8).otherwise(0.0)
    score = F.log(F.col("n_chunks") / F.col("df")) + F.least(n / 20, F.lit(0.5)) + bonus
    return sized.filter((F.col("df") >= 2) & (F.col("df") <= most)).withColumn("score", score)


def distinctive_terms(chunks: DataFrame, most: int = 40, by_source: bool = False, first_chunks: int | None = None) -> DataFrame:
    """The best ``most`` terms of the corpus or of each source, ranked; ties by first sight."""
    scored = scored_terms(chunks, by_source, first_chunks)
    order = [F.round("score", 9).desc(), "first_seen"]
    if by_source:
        rank = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select("source_id", "rank", "word", "df", "score")
    best = scored.orderBy(*order).limit(most)  # a top-k, so what is ranked next is ``most`` rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "word", "df", "score")
