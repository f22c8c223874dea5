"""Batched ranked search over chunks: phrases, BM25, substring and spelling fallbacks.

Queries are a table (query_id, query, source, k), all answered at once. Only tokens that some query has leave the
scan of the chunks, so the postings that are shuffled grow with the hits and not with the corpus. Corpus statistics
(number of chunks, mean length) are one row; they and document frequencies never see the source filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import like_source, substring_count, tokens
from lodestone.operators.fuzzy import correct
from lodestone.operators.stem import stem_tokens
from lodestone.sources.shared import stored

K1, B, TITLE_WEIGHT, CONTENT_WEIGHT, LEAST_IDF = 1.2, 0.75, 2.0, 1.0, 1e-6
CHUNK = ["source_id", "chunk_ord"]


def sanitized_words(query: Column) -> Column:
    """The words of a query that are searched for: no specials, no operators, at least two characters."""
    plain = F.regexp_replace(query, r"""['"(){}\[\]*:^~]""", " ")
    plain = F.regexp_replace(plain, r"(?i)\b(AND|OR|NOT|NEAR)\b", " ")
    return F.filter(F.split(plain, r"(?U)[\s﻿]+"), lambda w: F.char_length(w) >= 2)


def match_expression(query: Column) -> Column:
    """The words quoted and joined by OR; empty if there are none."""
    return F.array_join(F.transform(sanitized_words(query), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase (ordinal of the word), offset, token, phrase_len: each word is a phrase of adjacent tokens."""
    words = queries.select("query_id", F.posexplode(sanitized_words(F.col("query"))).alias("phrase", "word"))
    found = words.withColumn("parts", tokens(F.col("word")))
    return found.select("query_id", "phrase", F.size("parts").alias("phrase_len"), F.posexplode("parts").alias("offset", "token"))


def postings(chunks: DataFrame) -> DataFrame:
    """token, source_id, chunk_ord, field (0 title, 1 content), pos."""
    fields = F.array(F.struct(F.lit(0).alias("field"), tokens(F.col("title")).alias("t")), F.struct(F.lit(1).alias("field"), tokens(F.col("content")).alias("t")))
    each = chunks.select(*CHUNK, F.explode(fields).alias("f"))
    return each.select(*CHUNK, "f.field", F.posexplode("f.t").alias("pos", "token"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """Tokens of title and content of each chunk."""
    return chunks.select(*CHUNK, (F.size(tokens(F.col("title"))) + F.size(tokens(F.col("content")))).alias("dl"))


def corpus(lengths: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def phrase_hits(chunks: DataFrame, queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """query_id, phrase, source_id, chunk_ord, weighted: the weighted count of a phrase's occurrences in a chunk."""
    wanted, posted = query_phrases(queries), postings(chunks)
    if stemmed:  # of all tokens, only those with a stem that some query has are kept
        wanted = stem_tokens(wanted)
        kin = stem_tokens(posted.select("token").distinct().withColumn("stem", F.col("token")), "stem")
        kin = kin.join(wanted.select(F.col("token").alias("stem")).distinct(), "stem", "left_semi")
        posted = posted.join(kin, "token").drop("token").withColumnRenamed("stem", "token")
    met = posted.join(wanted, "token").withColumn("start", F.col("pos") - F.col("offset"))
    one = met.filter("phrase_len = 1").select("query_id", "phrase", *CHUNK, "field", "start")
    longer = met.filter("phrase_len > 1").groupBy("query_id", "phrase", *CHUNK, "field", "start", "phrase_len").agg(F.count(F.lit(1)).alias("n")).filter("n = phrase_len")
    hits = one.unionByName(longer.select(*one.columns))
    weight = F.when(F.col("field") == 0, TITLE_WEIGHT).otherwise(CONTENT_WEIGHT)
    return hits.groupBy("query_id", "phrase", *CHUNK).agg(F.sum(weight).alias("weighted"))


def bm25(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """query_id, source_id, chunk_ord, score: summed over phrases, repeated phrases too."""
    df = hits.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("df"))
    whole = corpus(lengths)
    met = hits.join(df, ["query_id", "phrase"]).join(lengths, CHUNK).crossJoin(F.broadcast(whole))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    tf = F.col("weighted")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.withColumn("part", part).groupBy("query_id", *CHUNK).agg(F.sum("part").alias("score"))


def top(scored: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The best k hits of each query that its source filter lets through, ranked; ties by chunk."""
    names = chunks.select(*CHUNK, "label", "title", "content")
    limits = queries.select("query_id", F.col("source").alias("wanted"), "k")
    kept = scored.join(limits, "query_id").join(names.select(*CHUNK, "label"), CHUNK).filter(F.col("wanted").isNull() | like_source(F.col("label"), F.col("wanted")))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *CHUNK)
    best = kept.withColumn("rank", F.row_number().over(order)).filter("rank <= k").drop("wanted", "label", "k")
    return best.join(names, CHUNK)


def word_search(chunks: DataFrame, queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """First layer: words and phrases. query_id, rank, source_id, chunk_ord, score, label, title, content."""
    return top(bm25(phrase_hits(chunks, queries, stemmed), chunk_lengths(chunks)), chunks, queries)


def substring_hits(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Like ``phrase_hits`` for words of three or more characters as case-folded substrings, overlaps counted.

    The words of all queries form one row that meets each chunk once; nothing is paired that does not match.
    """
    words = queries.select("query_id", F.posexplode(sanitized_words(F.col("query"))).alias("phrase", "word")).filter("char_length(word) >= 3")
    row = words.agg(F.collect_list(F.struct("query_id", "phrase", F.lower("word").alias("word"))).alias("words"))
    low = chunks.select(*CHUNK, F.lower("title").alias("t"), F.lower("content").alias("c")).crossJoin(F.broadcast(row))  # one row
    met = low.select(*CHUNK, "t", "c", F.explode(F.filter("words", lambda w: F.col("t").contains(w["word"]) | F.col("c").contains(w["word"]))).alias("w"))
    weighted = TITLE_WEIGHT * substring_count(F.col("t"), F.col("w.word")) + CONTENT_WEIGHT * substring_count(F.col("c"), F.col("w.word"))
    return met.select("w.query_id", "w.phrase", *CHUNK, weighted.alias("weighted"))


def substring_lengths(chunks: DataFrame) -> DataFrame:
    """Trigrams of title and content of each chunk."""
    grams = lambda c: F.greatest(F.char_length(c) - 2, F.lit(0))
    return chunks.select(*CHUNK, (grams("title") + grams("content")).alias("dl"))


def substring_search(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Second layer: substrings."""
    return top(bm25(substring_hits(chunks, queries), substring_lengths(chunks)), chunks, queries)


def cascade(chunks: DataFrame, queries: DataFrame, vocabulary: DataFrame, stemmed: bool = True) -> DataFrame:
    """Words first; for queries without a hit substrings; for those without one either, words of the corrected query.

    The source filter takes part in "without a hit". Adds ``layer`` and ``corrected``. Each layer's hits, k for each
    query at most, are written to the shared folder, as the next layers ask which queries have none.
    """
    queries = stored(queries, "queries")
    first = stored(word_search(chunks, queries, stemmed), "words")
    left = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = stored(substring_search(chunks, left), "substrings")
    left = left.join(second.select("query_id").distinct(), "query_id", "left_anti")
    corrected = stored(correct(left, vocabulary), "corrected")
    again = left.drop("query").join(corrected, "query_id").withColumnRenamed("corrected", "query")
    third = word_search(chunks, again, stemmed).join(corrected, "query_id")
    none = F.lit(None).cast("string")
    return (
        first.withColumns({"layer": F.lit("word"), "corrected": none})
        .unionByName(second.withColumns({"layer": F.lit("substring"), "corrected": none}))
        .unionByName(third.withColumn("layer", F.lit("fuzzy")))
    )
