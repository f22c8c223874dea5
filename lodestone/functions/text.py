"""Text primitives as Column expressions. Everything here stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a text (fixed values).
STOP_WORDS = (
    "the and for are but not you all can had her was one our out has his how its may now old see way who did say she too "
    "will with this that from they been have many some them than each like just over such take into year your good could "
    "would about which their there other after should through also more most only very when what then these those being "
    "does done both same still while where here were much"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside array lambdas an outer expression is evaluated anew for every element; bound like this it is a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Unicode white space and the byte order mark.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def js_trim(text: Column) -> Column:
    """Strip all Unicode white space and byte order marks from both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))  # a pattern would be tried at every space inside


def lines(text: Column) -> Column:
    """The lines of a text; an empty text has one."""
    return F.split(text, "\n", -1)


def _accents() -> tuple[str, str]:
    """Latin letters with one diacritic and their bases, by canonical decomposition."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(c))) == 2]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(text: Column) -> Column:
    """Lower case without diacritics of single-diacritic Latin letters or combining marks."""
    low = F.lower(text)
    # Combining marks come after the letters and have no counterpart, so they go. ASCII texts need none of it.
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, _FROM.lower() + _MARKS, _TO.lower()))


def tokens(text: Column) -> Column:
    """Folded maximal runs of letters and numbers."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def vocabulary_words(text: Column) -> Column:
    """Lower-case runs of letters, numbers, ``_`` and ``-`` of three or more characters, without stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_-]+")
    return F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(STOP_WORDS))


def format_bytes(n: Column) -> Column:
    """A byte count with one decimal, rounded half up exactly: 500B, 2.0KB, 5.0MB."""
    n = n.cast("long")

    def tenths(unit: int) -> Column:
        t = F.floor((n * 10 + unit // 2) / unit).cast("long")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024 * 1024, F.concat(tenths(1024), F.lit("KB"))).otherwise(F.concat(tenths(1024 * 1024), F.lit("MB")))


def place(*parts: Column) -> Column:
    """A long and then positions from 0 to 2^31 - 1 as one decimal in the same order, a null long first. Least values of it are kept by hash aggregation."""
    first = F.coalesce(parts[0].cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)"))
    for p in parts[1:]:
        first = (first * F.lit(Decimal(1 << 31)).cast("decimal(10,0)")).cast("decimal(38,0)") + p.cast("decimal(10,0)")
    return first.cast("decimal(38,0)")


def place_parts(value: Column) -> tuple[Column, Column]:
    """The long and the position of a ``place`` of two."""
    unit = F.lit(Decimal(1 << 31)).cast("decimal(10,0)")
    pos = F.pmod(value, unit)
    whole = F.try_divide(value - pos, unit).cast("decimal(38,0)")
    return F.when(whole >= F.lit(Decimal(-(1 << 63))), whole.cast("long")), pos.cast("int")


def code_point(n: Column) -> Column:
    """The character of a code point; empty if there is none."""
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")


def like_source(label: Column, pattern: Column) -> Column:
    """Substring filter on a label: ASCII letters fold, ``%`` and ``_`` stay wildcards, a backslash is itself."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    escaped = F.replace(F.translate(pattern, upper, low), F.lit("\\"), F.lit("\\\\"))
    return F.like(F.translate(label, upper, low), F.concat(F.lit("%"), escaped, F.lit("%")))


def overlaps_itself(word: Column) -> Column:
    """Whether a word begins as it ends, so that two occurrences can overlap."""
    n = F.char_length(word)
    return F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (k < n) & (F.substring(word, F.lit(1), k) == F.right(word, k)))


def substring_count(text: Column, word: Column, overlaps: Column | None = None) -> Column:
    """Occurrences of a word in a text, overlapping ones too.

    A word that can't overlap itself is counted by what its removal takes away. ``overlaps`` is ``overlaps_itself``, if that is known.
    """
    apart = ((F.octet_length(text) - F.octet_length(F.replace(text, word, F.lit("")))) / F.octet_length(word)).cast("int")
    return F.when(~(overlaps_itself(word) if overlaps is None else overlaps), apart).otherwise(_overlapping(text, word))


def _overlapping(text: Column, word: Column) -> Column:
    return F.regexp_count(text, F.concat(F.lit("(?=\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)")))
