"""Winnowing fingerprints over characters; DataFrame operations only.

Symbols are the code points of a text, hashed to 64 bits. Every ``k`` of them in a row have a cyclic-polynomial hash
without the wrap: the symbols' hashes, each shifted one bit further than its successor, added modulo 2; the upper 32 bits count, in
which every symbol takes part. The hashes of all k-grams are rolled up together by doubling: those of 2m symbols come from
those of m, which overlapping k-grams share. Of each ``window`` k-grams in a row the least is chosen, the rightmost of equal ones. A
fingerprint lists the chosen hashes (32 bits) with their positions. Any passage of at least k + window - 1 characters
that two texts share, wherever it stands, gives them a common hash, and none shorter than k characters does (but for
hashes that are equal by chance).

The least of a window comes from one number for each k-gram, hash above and reversed position below, so that ties go to
the right by themselves. The fingerprint of an edited text is put together from those of its two sources, away from the seam and
the ends, and of the stretches there; it equals the one taken directly.

Defined cases: null text is empty. An empty text has the empty fingerprint; two empty fingerprints have
likeness 1, an empty and another one 0. A text of fewer than k characters is one k-gram, of fewer k-grams than a window
one window. Texts of any length are taken whole. Rows with equal doc_id follow each other by text; null doc_ids come
last in descending order. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import stored

#: Characters in a k-gram: an even number, up to 32.
K = 16
WINDOW = 32
#: Documents in one range of the order, about.
RANGE = 1000
#: Ranges at most, since their bounds go through the driver; beyond it ranges get longer.
MOST_RANGES = 8192
_LOW = (1 << 31) - 1
_HIGH = -(1 << 32)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, not for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _from(v: Column, start: int) -> Column:
    """The array from the element ``start`` (from 0) on."""
    return F.slice(v, start + 1, F.size(v))


def _rolled(symbols: Column, m: int) -> Column:
    """Hashes of every ``m`` symbols in a row; null where fewer follow."""
    if m == 1:
        return symbols
    half = m // 2
    even = _let(_rolled(symbols, half), lambda v: F.zip_with(v, _from(v, half), lambda a, b: F.shiftleft(a, half).bitwiseXOR(b)))
    return F.zip_with(even, _from(symbols, m - 1), lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b)) if m % 2 else even


def _grams(text: Column, k: int) -> Column:
    """Every k-gram of a text of k characters at least: hash in the upper 32 bits, reversed position below."""
    half = k // 2

    def packed(v: Column) -> Column:
        def gram(x: Column, i: Column) -> Column:
            return F.shiftleft(x, half).bitwiseXOR(F.get(v, i + half)).bitwiseAND(F.lit(_HIGH)).bitwiseOR(F.lit(_LOW - 1) - i)

        return F.transform(F.slice(v, F.lit(1), F.size(v) - (k - 1)), gram)

    symbols = F.transform(F.split(text, ""), lambda c: F.xxhash64(c))
    return _let(symbols, lambda h: _let(_rolled(h, half), packed))


def _least(grams: Column, window: int) -> Column:
    """The least of each window of k-grams, once each."""

    def widened(v: Column, reach: int) -> Column:
        if reach == window:
            return F.array_distinct(v)
        # The least of the next ``reach`` becomes that of up to twice as many.
        step = min(reach, window - reach)
        kept = F.greatest(F.size(v) - step, F.lit(1))
        return _let(F.zip_with(F.slice(v, F.lit(1), kept), F.slice(v, F.lit(step + 1), kept), lambda a, b: F.least(a, b)), lambda x: widened(x, reach + step))

    # Fewer k-grams than a window are one window.
    return _let(grams, lambda g: F.when(F.size(g) < window, F.array(F.array_min(g))).otherwise(widened(g, 1)))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<long> of the chosen k-grams in order of position: hash in the upper 32 bits, reversed position below."""
    if k % 2 or not 2 <= k <= 32:
        raise ValueError("k must be an even number from 2 to 32")
    size = F.char_length(text)
    short = F.array(F.xxhash64(text).bitwiseAND(F.lit(_HIGH)).bitwiseOR(F.lit(_LOW - 1)))
    return F.when(size == 0, F.array().cast("array<long>")).when(size < k, short).otherwise(_least(_grams(text, k), window))


def _position(x: Column) -> Column:
    return F.lit(_LOW - 1) - x.bitwiseAND(F.lit(0xFFFFFFFF))


def hashes(chosen: Column) -> Column:
    """The different hashes of a fingerprint."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 32).cast("int")))


def positions(chosen: Column) -> Column:
    """The positions (number of the first character, from 0) of a fingerprint's k-grams."""
    return F.transform(chosen, lambda x: (F.lit(_LOW - 1) - x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int"))


def shown(chosen: Column) -> Column:
    """A fingerprint as text: hash in hex @ position, comma-joined."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0")), F.lit("@"), (F.lit(_LOW - 1) - x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets, from 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text, chosen (see ``fingerprint``) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("chosen", fingerprint(F.col("text"), k, window))


def _with_next(docs: DataFrame, k: int, window: int) -> DataFrame:
    """Each row with its fingerprint in ``chosen``, and both of the next one by descending doc_id (after the last: the first) in
    ``next`` and ``next_chosen``.

    Ranges of doc_id, bounded by quantiles, are ordered apart. The first row of each range also goes, as a guest,
    to the end of the range before; these are as many as there are ranges.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = base.count()
    ranges = min(MOST_RANGES, max(1, -(-count // RANGE)))
    cuts = [] if ranges == 1 else sorted(set(base.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    # The number of the range: cut points at or below the id; null is below all.
    at = F.lit(0) if not cuts else F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(F.col("doc_id").cast("double"), cuts))
    ranged = base.withColumn("range", at.cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    heads = ranged.groupBy("range").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", F.xxhash64("text").alias("hash"))).alias("top"))
    heads = stored(heads.select("range", "top.doc_id"), "heads")
    # Of a range's first doc_id, its greatest text. The previous range in descending order has the next higher number.
    tops = ranged.join(F.broadcast(heads.withColumnsRenamed({"range": "r", "doc_id": "d"})), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).groupBy("range").agg(F.max("text").alias("text"))
    wrap = F.coalesce(F.lag("range").over(Window.orderBy(F.col("range").desc())), F.min("range").over(Window.partitionBy(F.lit(1))))
    guests = tops.withColumn("range", wrap.cast("int")).select(F.lit(None).cast("long").alias("doc_id"), "text", "range", F.lit(True).alias("guest")).withColumn("chosen", fingerprint(F.col("text"), k, window))
    dealt = ranged.withColumn("guest", F.lit(False)).withColumn("chosen", fingerprint(F.col("text"), k, window)).unionByName(guests)
    ordered = Window.partitionBy("range").orderBy("guest", *order)
    both = dealt.withColumns({"next": F.lead("text").over(ordered), "next_chosen": F.lead("chosen").over(ordered)})
    return both.filter(~F.col("guest")).select("doc_id", "text", "chosen", "next", "next_chosen")


def _bucket(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cut points are at or below the value, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    if len(cuts) <= 64:
        return F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value))
    return F.when(value < cuts[mid], _bucket(value, cuts[:mid])).otherwise(_bucket(value, cuts[mid:][1:]) + mid + 1)


def _edited_fingerprint(k: int, window: int) -> Column:
    """The fingerprint of the first ``kept`` characters of ``text`` and the first ``taken`` of ``next``, which is ``edited``.

    What is chosen at a position depends on the ``span`` characters to its right and ``window`` - 1 to its left, so
    away from seam and end it is what was chosen in the source. For the rest, stretches of ``edge`` characters are enough.
    """
    span, edge = k + window - 1, k + 2 * window
    kept, taken, following = F.col("kept"), F.col("taken"), F.col("next")

    def stretch(text: Column, start: Column) -> Column:
        return F.transform(fingerprint(text, k, window), lambda x: x - start)

    far = taken >= 2 * edge
    seam = stretch(F.concat(F.substring("text", kept - edge + 1, F.lit(edge)), F.substring(following, F.lit(1), F.when(far, F.lit(edge)).otherwise(taken))), kept - edge)
    before = F.filter("chosen", lambda x: _position(x) <= kept - span)
    around = F.filter(seam, lambda x: (_position(x) > kept - span) & (~far | (_position(x) <= kept + window)))
    after = F.transform(F.filter("next_chosen", lambda x: (_position(x) > window) & (_position(x) <= taken - span)), lambda x: x - kept)
    end = F.filter(stretch(F.substring(following, taken - edge + 1, F.lit(edge)), kept + taken - edge), lambda x: _position(x) > kept + taken - span)
    return F.when(kept < edge, fingerprint(F.col("edited"), k, window)).when(far, F.concat(before, around, after, end)).otherwise(F.concat(before, around))


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last half (rounded down, in code points) replaced by the first as many code points, or
    all, of the next document by descending doc_id. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    # The barrier of a generator keeps each value from being computed again wherever it is used.
    cut = F.struct(n.alias("n_chars"), (n - half).alias("kept"), F.least(half, F.char_length("next")).alias("taken"), F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("next", F.lit(1), half)).alias("edited"))
    texts = _with_next(docs, k, window).select("*", F.inline(F.array(cut)))
    made = F.struct(F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), _edited_fingerprint(k, window).alias("new"), hashes(F.col("chosen")).alias("own_set"), hashes(F.col("next_chosen")).alias("next_set"))
    found = texts.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "chosen", F.inline(F.array(made)))
    sets = found.select("*", F.explode(F.array(hashes(F.col("new")))).alias("new_set"))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("chosen")).alias("fingerprint"), shown(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("new_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
