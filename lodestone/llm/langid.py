"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts all of its substrings. A text is parsed against it greedily:
each phrase is the longest match that starts where the last one ended. The fewer phrases, weighted by the logarithm of the
reference's length, the lower the cross entropy; the language with the least wins.

Every letter of a reference, of whatever script, has a symbol; symbols are letters in lower case, and runs of anything
else are one blank. A letter that a language's reference lacks is a phrase of its own there. The transitions of an automaton
are kept sparse, in one array by row displacement: a state is an offset, and the entry at offset + symbol names the state
it belongs to and the next one (where it belongs to another, a phrase ended and the start's move is taken). So a step for
thousands of text pieces is one array lookup. Texts are parsed whole, in pieces of ``PIECE`` symbols; a cut adds one
phrase at most, to every language alike.

Learned from at most ``SAMPLE`` rows for each language (least hash first), of each a part of ``PART`` characters from
its middle on (of a text that short, all). All languages that have a labelled row are learned.

Defined cases: null text or text without letter is ``und`` with score 0, and so is every text if nothing is labelled.
A null lang teaches nothing. Ties go to the first language by name. Repeated or null doc_ids keep their rows
(held_out of null is null); other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import small_batches, tidy

SAMPLE = 120
PART = 400
PIECE = 512
#: Symbols parsed at once.
AT_ONCE = 1 << 21
_BLANK, _RARE = 0, 1
#: Offsets tried for a state before it is put at the end.
TRIES = 200


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start. Every path from it spells a substring, and every substring has one."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new, at = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            old = step[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                twin = len(step)
                step.append(dict(step[old]))
                link.append(link[old])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(c) == old:
                    step[at][c] = twin
                    at = link[at]
                link[old] = link[new] = twin
        last = new
    return step


def displaced(steps: list[dict[int, int]], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions in one array: (entries, offset of each state). The entry at offset + symbol holds the offset of the
    state it belongs to in its upper half and that of the next state in its lower half; -1 where there is none."""
    room = 2 * sum(map(len, steps)) + 1
    used, taken, offsets, x = bytearray(room + columns), bytearray(room), [0] * len(steps), 1
    for state in sorted(range(len(steps)), key=lambda i: -len(steps[i])):
        moves = steps[state]
        for _ in range(TRIES):
            x = (x * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
            at = (x >> 32) % room
            if not taken[at] and not any(used[at + c] for c in moves):
                break
        else:
            at = len(used)
            taken += bytes(at + 1 - len(taken))
            used += bytes(columns)
        taken[at], offsets[state] = 1, at
        for c in moves:
            used[at + c] = 1
    entries = np.full(len(used), -1, np.int64)
    for state, moves in enumerate(steps):
        for c, to in moves.items():
            entries[offsets[state] + c] = offsets[state] << 32 | offsets[to]
    return entries, np.array(offsets, np.int64)


def _folded(c: str) -> str:
    return c.lower()[0]


class Parser:
    """Cross-parses texts against labelled samples: ``samples`` has (lang, text) rows."""

    def __init__(self, samples: list[tuple[str, str]]):
        texts: dict[str, list[str]] = {}
        for lang, t in sorted(samples):
            texts.setdefault(lang, []).append(t)
        self.langs = sorted(texts)
        letters = {c for _, t in samples for c in set(t) if c.isalpha()}
        self.of = {c: i + 2 for i, c in enumerate(sorted({_folded(c) for c in letters}))}
        self.columns = len(self.of) + 2
        self.symbol = np.full(0x110000, -1, np.int32)  # filled as code points come up
        self.entries, self.roots, self.starts, self.bits = [], [], [], []
        for lang in self.langs:
            reference = self.symbols(" ".join(texts[lang])).tolist()
            steps = suffix_automaton(reference)
            entries, offsets = displaced(steps, self.columns)
            start = np.full(self.columns, offsets[0])  # a symbol that the reference lacks is a phrase of its own
            for c, to in steps[0].items():
                start[c] = offsets[to]
            self.entries.append(entries)
            self.roots.append(offsets[0])
            self.starts.append(start)
            self.bits.append(math.log2(len(reference) + 2))

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of blanks as one."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol[codes]
        if (out < 0).any():
            for i in np.unique(codes[out < 0]).tolist():
                self.symbol[i] = self.of.get(_folded(chr(i)), _RARE) if chr(i).isalpha() else _BLANK
            out = self.symbol[codes]
        return out[np.concatenate(([True], (out[1:] != _BLANK) | (out[:-1] != _BLANK)))] if len(out) else out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each symbol sequence (rows) against each language (columns)."""
        pieces = [-(-len(t) // PIECE) for t in texts]
        width = min(PIECE, max(map(len, texts)))
        lanes = np.zeros((sum(pieces), width), np.int32)
        sizes = np.full(len(lanes), width)
        at = 0
        for t, n in zip(texts, pieces, strict=True):
            lanes[at : at + n].reshape(-1)[: len(t)] = t
            at += n
            if n:
                sizes[at - 1] = len(t) - (n - 1) * width
        order = np.argsort(-sizes, kind="stable")
        lanes = np.ascontiguousarray(lanes[order].T)
        active = np.searchsorted(-sizes[order], -np.arange(width), side="left")
        owner = np.repeat(np.arange(len(texts)), pieces)[order]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, (entries, root, start) in enumerate(zip(self.entries, self.roots, self.starts, strict=True)):
            state = np.full(len(order), root)
            counts = np.zeros(len(order), np.int64)
            for i in range(width):
                n = active[i]
                found = entries.take(state[:n] + lanes[i, :n])
                ended = (found >> 32) != state[:n]
                counts[:n] += ended
                state[:n] = np.where(ended, start.take(lanes[i, :n]), found & 0xFFFFFFFF)
            np.add.at(out[:, k], owner, counts)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        answers: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return answers
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            cost = self.phrases([s for _, s in held]) * np.array(self.bits)
            best = np.argmin(cost, axis=1)
            # A bit of cross entropy less doubles the odds; tempered, as the phrases of a text depend on each other.
            odds = np.exp2(np.maximum(-60, (cost[np.arange(len(best)), best][:, None] - cost) / 4)).sum(axis=1)
            for (i, _), b, o in zip(held, best, odds, strict=True):
                answers[i] = (self.langs[b], float(1 / o))

        for i, t in enumerate(texts):
            s = self.symbols(t) if t else None
            if s is not None and (s != _BLANK).any():
                held.append((i, s))
                size += len(s)
                if size >= AT_ONCE:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return answers


_PARSERS: dict[str, Parser] = {}


def _parser(name: str, samples: list[tuple[str, str]]) -> Parser:
    """The worker's parser for one run, built once. A function of the module, since what a stage's own code refers to is copied for each task."""
    if name not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[name] = Parser(samples)
    return _PARSERS[name]


def held_out():
    """crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, part of a text) to learn from: ``SAMPLE`` rows of each language at most."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = slim.filter(F.col("lang").isNotNull() & F.coalesce(~held_out(), F.lit(False)) & (F.char_length("text") > 0))
    part = F.expr(f"substring(text, if(char_length(text) <= {PART}, 1, cast(char_length(text) / 2 as int) + 1), {PART})")
    chosen = usable.select("lang", part.alias("part"), F.xxhash64("doc_id").alias("h"), "doc_id")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "part"))
    return [(r.lang, r.part) for r in chosen.withColumn("number", number).filter(f"number <= {SAMPLE}").collect()]


def identify(docs: DataFrame, samples: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the labelled rows of ``docs`` unless given samples."""
    import uuid

    spark = docs.sparkSession
    small_batches(spark)
    samples = labelled_sample(docs) if samples is None else samples
    shared, name = spark.sparkContext.broadcast(samples), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(name, shared.value)
        held: list[pa.RecordBatch] = []

        def answer() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks()
            found = parser.predict(batch.column("text").to_pylist())
            columns = [batch.column(c).combine_chunks() for c in ("doc_id", "held_out")]
            return pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > AT_ONCE:
                yield answer()
                held = []
        if held:
            yield answer()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return slim.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
