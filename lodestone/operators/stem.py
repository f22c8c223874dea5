"""The classic English suffix stemmer (Porter, 1980), as rules over measures and suffix tables.

Words of fewer than three UTF-8 bytes stay. The rules run once for each different word: ``stem_tokens`` stems the
distinct tokens of a table in Arrow batches and joins the result back.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes and what replaces them, tried in this order, if the stem's measure is above the limit.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"

_TWO, _THREE = ([tuple(x.split(":")) for x in t.split()] for t in (STEP_2, STEP_3))
_FOUR = sorted(STEP_4.split(), key=len, reverse=True)


def _kinds(word: str) -> str:
    """One letter for each character: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = []
    for i, c in enumerate(word):
        out.append("v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: list[tuple[str, str]], least: int) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word.encode()) < 3:
        return word
    # Plurals.
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive.
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _kinds(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, _TWO, 0)
    word = _swap(word, _THREE, 0)
    for suffix in _FOUR:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(column: str) -> Column:
    """The stem of each token of a column."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return stems(column)


def stem_tokens(df: DataFrame, column: str = "token") -> DataFrame:
    """``df`` with the tokens of a column stemmed."""
    known = df.select(F.col(column).alias("__word")).distinct().withColumn("__stem", stemmed("__word"))
    rest = [c for c in df.columns if c != column]
    return df.join(known, F.col(column) == F.col("__word")).select(*rest, F.col("__stem").alias(column))
