"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters may occur in a text with up to k = floor(L * ``rate``) edits. Cut into k + 1 pieces, an
occurrence within that budget leaves at least one piece as it is. One automaton finds all pieces of all items in
one pass over a whole text; each place where a piece says the item would lie is verified by Myers' bit-parallel
edit distance, in which a column of the distance table is one integer.

Texts and items are compared in lower case with white space runs as one blank. Items go out in blocks of at most
``BLOCK_CHARS`` characters, so what is broadcast is bounded; each block is one pass over the documents.

Defined cases: null and empty texts have no leaks; null and empty items match nothing. Equal items match each for
itself. Repeated or null ids keep their rows. An empty benchmark or table gives no leaks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import small_batches, tidy

RATE = 0.08
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to any part of ``text``, if within budget, and the first end of such a part."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score, best = full, 0, len(pattern), (budget + 1, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= budget else None


class Matcher:
    """The pieces of a block of items, to be found in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(len(text) * rate)
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str, any_is_enough: bool = False) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normal text) of each item within its budget: its best place."""
        if not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for item, offset in where:
                starts.setdefault(item, set()).add(last + 1 - size - offset)
        found = []
        for item, places in starts.items():
            item_id, pattern, budget = self.items[item]
            best: tuple[int, int] | None = None
            ranges: list[list[int]] = []
            for s in sorted(places):  # places that the budget lets overlap are verified together
                a, b = max(0, s - budget), s + len(pattern) + budget
                if ranges and a <= ranges[-1][1] - len(pattern) + budget:
                    ranges[-1][1] = b
                else:
                    ranges.append([a, b])
            for a, b in ranges:
                if (m := myers(pattern, text[a:b], budget)) is not None and (best is None or m[0] < best[0]):
                    best = (m[0], a + m[1])
            if best is not None:
                found.append((item_id, *best))
                if any_is_enough:
                    break
        return found


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(block, rate: float) -> Matcher:
    key = (block.value[0], rate)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(block.value[1], rate)
    return _MATCHERS[key]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        if held and size + len(text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


def _broadcasts(docs: DataFrame, benchmark: DataFrame) -> list:
    import uuid

    small_batches(docs.sparkSession)
    return [docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in _blocks(benchmark)]


LEAKS = "doc_id long, item_id long, distance long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document and item that occurs in it within the edit budget: doc_id, item_id, distance, end.

    ``end`` is where the best match ends in the normal form of the text.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matcher = _matcher(block, rate)
                rows = [(d, *f) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for f in matcher.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "item_id", "distance", "end"])

        return run

    found = [slim.mapInArrow(tidy(search(b)), LEAKS) for b in _broadcasts(docs, benchmark)]
    if not found:
        return slim.limit(0).selectExpr("doc_id", "0L AS item_id", "0L AS distance", "0L AS end")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` less the rows whose text holds an item within its edit budget; all columns stay, nothing is shuffled."""

    def keep(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matcher = _matcher(block, rate)
                mask = np.array([not (t and matcher.find(t, any_is_enough=True)) for t in batch.column(at).to_pylist()], bool)
                yield batch.filter(pa.array(mask))

        return run

    at = [c.lower() for c in docs.columns].index("text")
    for block in _broadcasts(docs, benchmark):
        docs = docs.mapInArrow(tidy(keep(block)), docs.schema)
    return docs
