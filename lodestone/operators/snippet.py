"""Snippets: windows around hits, merged, within a length budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, tokens
from lodestone.operators.search import CHUNK, query_phrases, sanitized_words
from lodestone.operators.stem import stem_tokens

WINDOW, MOST = 300, 1500
OPEN, CLOSE = "\u0002", "\u0003"


def _offsets(pieces: Column) -> Column:
    """Where each piece but the first begins in the pieces joined together, each length counted once."""
    state = "struct<at:int,found:array<int>>"

    def step(s: Column, piece: Column) -> Column:
        at = (s["at"] + F.char_length(piece)).cast("int")
        return F.struct(at.alias("at"), F.concat(s["found"], F.array(at)).alias("found")).cast(state)

    none = F.from_json(F.lit('{"at":0,"found":[]}'), state)
    return F.aggregate(pieces, none, step, lambda s: F.slice(s["found"], F.lit(1), F.greatest(F.size(s["found"]) - 1, F.lit(0))))


def marker_positions(marked: Column) -> Column:
    """Offsets of the opening marks in the text without marks."""
    return _offsets(F.split(F.replace(marked, F.lit(CLOSE), F.lit("")), OPEN, -1))


def strip_markers(marked: Column) -> Column:
    """The text without marks."""
    return F.translate(marked, OPEN + CLOSE, "")


def snippet_at(text: Column, positions: Column, most: int = MOST) -> Column:
    """The windows around ``positions`` that fit, joined by blank lines with ellipses where text is left out.

    Without positions, or within the budget, it is the text itself. If the first merged window is over the budget it is empty.
    """
    kind = "array<struct<start:int,end:int>>"

    def merged(n: Column) -> Column:
        windows = F.transform(F.array_sort(positions), lambda p: F.struct(F.greatest(p - WINDOW, F.lit(0)).cast("int").alias("start"), F.least(p + WINDOW, n).cast("int").alias("end")))

        def join(acc: Column, w: Column) -> Column:
            last = F.element_at(acc, -1)
            grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))
            return F.when((F.size(acc) > 0) & (w["start"] <= F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(w))).cast(kind)

        return F.aggregate(windows, F.array().cast(kind), join)

    def render(ws: Column) -> Column:
        state = "struct<total:int,n:int,open:boolean>"

        def take(s: Column, w: Column) -> Column:
            size = w["end"] - w["start"]
            fits = s["open"] & (s["total"] + size <= most)
            return F.when(fits, F.struct((s["total"] + size).alias("total"), (s["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(s["total"].alias("total"), s["n"].alias("n"), F.lit(False).alias("open"))).cast(state)

        def shown(kept: Column) -> Column:
            def part(w: Column, i: Column) -> Column:
                lead = F.when((i == 0) & (w["start"] > 0), "…").otherwise("")
                trail = F.when((i < kept["n"] - 1) | (w["end"] < F.char_length(text)), "…").otherwise("")
                return F.concat(lead, F.substring(text, w["start"] + 1, w["end"] - w["start"]), trail)

            return F.array_join(F.transform(F.slice(ws, F.lit(1), kept["n"]), part), "\n\n")

        return let(F.aggregate(ws, F.from_json(F.lit('{"total":0,"n":0,"open":true}'), state), take), shown)

    plain = (F.size(positions) <= 0) | positions.isNull() | (F.char_length(text) <= most)
    return F.when(plain, text).otherwise(let(F.char_length(text), lambda n: let(merged(n), render)))


def snippet(marked: Column, most: int = MOST) -> Column:
    """Snippet of a text with marks."""
    return snippet_at(strip_markers(marked), marker_positions(marked), most)


def hit_positions(hits: DataFrame, queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """query_id, rank, chunk, positions: character offsets in the content where a phrase of the query begins.

    Works on the ranked hits alone, k for each query. Offsets are found by cutting the content at its tokens.
    """
    own = ["query_id", "rank", *CHUNK]
    parts = F.regexp_extract_all(F.col("content"), F.lit(r"(?s)([^\p{L}\p{N}]*)([\p{L}\p{N}]+\p{M}*)"), 0)
    ends = F.transform(parts, lambda p: F.char_length(p))
    each = hits.select(*own, F.posexplode(F.arrays_zip(parts.alias("p"), ends.alias("n"))).alias("pos", "x"))
    until = F.sum("x.n").over(Window.partitionBy("query_id", "rank").orderBy("pos"))
    word = F.regexp_extract("x.p", r"(?s)[^\p{L}\p{N}]*([\p{L}\p{N}]+\p{M}*)\z", 1)
    placed = each.select(*own, "pos", (until - F.char_length(word)).alias("at"), F.get(tokens(word), F.lit(0)).alias("token"))
    wanted = query_phrases(queries)
    if stemmed:
        placed, wanted = stem_tokens(placed), stem_tokens(wanted)
    met = placed.join(wanted, ["query_id", "token"]).withColumn("start", F.col("pos") - F.col("offset"))
    full = met.groupBy(*own, "phrase", "start", "phrase_len").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).filter("n = phrase_len")
    return full.groupBy(*own).agg(F.sort_array(F.collect_set(F.col("at").cast("int"))).alias("positions"))


def substring_marks(text: Column, words: Column) -> Column:
    """Where marks begin in a text if all occurrences of lower-case ``words`` are marked, overlapping ones as one, in any case of the text.

    The text is cut before every place at which some word begins; a place is a mark of its own if what is marked before has ended.
    """
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))  # no lower-case word holds \\E
    state = "struct<at:int,until:int,found:array<int>>"

    def marks(low: Column) -> Column:
        def step(s: Column, piece: Column) -> Column:
            reach = F.array_max(F.transform(words, lambda w: F.when(F.substring(low, s["at"] + 1, F.char_length(w)) == w, F.char_length(w)).otherwise(0)))
            new = (reach > 0) & (s["at"] >= s["until"])
            until = F.when(reach > 0, F.greatest(s["until"], s["at"] + reach)).otherwise(s["until"])
            found = F.when(new, F.concat(s["found"], F.array(s["at"]))).otherwise(s["found"])
            return F.struct((s["at"] + F.char_length(piece)).cast("int").alias("at"), until.cast("int").alias("until"), found.alias("found")).cast(state)

        zero = F.from_json(F.lit('{"at":0,"until":0,"found":[]}'), state)
        return F.aggregate(F.split(low, F.concat(F.lit("(?="), F.array_join(quoted, "|"), F.lit(")")), -1), zero, step, lambda s: s["found"])

    def placed(low: Column) -> Column:  # a few characters have a lower case of two
        origin = F.flatten(F.transform(F.split(text, ""), lambda c, i: F.array_repeat(i, F.char_length(F.lower(c)))))
        same = F.char_length(low) == F.char_length(text)
        return let(marks(low), lambda m: F.when(same, m).otherwise(let(origin, lambda o: F.transform(m, lambda p: F.get(o, p)))))

    none = F.array().cast("array<int>")
    return F.when((F.size(words) > 0) & (text != ""), let(F.lower(text), placed)).otherwise(none)


def substring_positions(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Like ``hit_positions`` for hits of the substring layer."""
    words = F.transform(F.filter(sanitized_words(F.col("query")), lambda w: F.char_length(w) >= 3), lambda w: F.lower(w))
    met = hits.join(queries.select("query_id", words.alias("words")), "query_id")
    return met.select("query_id", "rank", *CHUNK, substring_marks(F.col("content"), F.col("words")).alias("positions"))


def with_snippets(hits: DataFrame, queries: DataFrame, stemmed: bool = False, most: int = MOST, substrings: bool = False) -> DataFrame:
    """Ranked hits with ``snippet`` in place of the content; ``substrings`` says by which layer they were found."""
    at = substring_positions(hits, queries) if substrings else hit_positions(hits, queries, stemmed)
    return hits.join(at.drop(*CHUNK), ["query_id", "rank"], "left").withColumn("snippet", snippet_at(F.col("content"), F.col("positions"), most)).drop("content", "positions")
