"""Exact substring dedup over words by relative Lempel-Ziv parsing.

*Reference blocks.* All texts are indexed, cut into stretches: runs of windows with one anchor, the ``ANCHOR_WORDS``-word
gram of least rolling hash in them (the rightmost of equal ones). A stretch can only match stretches with its anchor, so
it is dealt by anchor, and a reference block is made of all stretches of some anchors, each different one once. To factor a
stretch against its block is to factor it against all blocks. Stretches whose anchor occurs once match nothing;
equal stretches, told by a 128-bit BLAKE2 digest of their words, are one factor as a whole.

*Factors.* A block's index names every window: words get numbers, and windows of 1, 2, 4, ... words get numbers from the
pairs of numbers of their halves, so that equal numbers are equal words, without hashing. A stretch is factored
greedily: where its next window has a source (another place with that window), the factor goes on as long as source and
stretch agree. Factors have at least a window's words. *Boundaries:* windows that reach over the end of a factor are looked
up on their own, as no one source has them all; where one has another source, the next factor begins there.

Defined cases: null or empty text: no words, the sha256 of nothing. Equal rows are copies of each other. Texts of
fewer words than the window lose nothing. Repeated or null doc_ids keep one result row for each input row. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm._common import tidy
from lodestone.llm._repeats import Units, covered, digest, with_spans
from lodestone.llm._rolling import Prefix, U, joined_words, row_words, text_bytes, word_symbols

ANCHOR_WORDS = 8
#: Bytes (in a single long text: words) handled at once; longer texts are cut into overlapping slices.
SLICE = 1 << 18
_LOW = 21


def anchors(symbols: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of each window, and the hashes of all grams."""
    width = window - gram + 1
    grams = Prefix(symbols).every(gram)
    low = U((1 << _LOW) - 1)
    ranked = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    count = len(symbols) - window + 1
    padded = np.full(-(-len(ranked) // width) * width, ~U(0), np.uint64)
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return (low - (np.minimum(right[:count], left[width - 1 : width - 1 + count]) & low)).astype(np.int64), grams


def window_names(words: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of ``window`` word numbers, by start; equal numbers for equal windows."""
    parts, at, names = [], 0, words
    size = 1
    while size <= window:
        if window & size:
            parts.append((names, size))
        size *= 2
        if size <= window:
            names = _paired(names[: max(0, len(names) - size // 2)], names[size // 2 :])
    n = max(0, len(words) - window + 1)
    out = np.zeros(n, np.int64)
    for i, (names, size) in enumerate(parts):
        piece = names[at : at + n]
        out = piece if i == 0 else _paired(out, piece)
        at += size
    return out


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


@dataclass(frozen=True)
class RelativeLempelZiv:
    """Units are stretches; their repeats are what their factors and the checked boundaries cover."""

    window: int
    gram: int = ANCHOR_WORDS
    slice: int = SLICE

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[Units]:
        row, rows = 0, len(offsets) - 1
        while row < rows:
            until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + self.slice, side="right")) - 1)
            part, edges = raw[offsets[row] : offsets[until]], offsets[row : until + 1] - offsets[row]
            starts, ends, cuts = row_words(part, edges)
            symbols = word_symbols(part, starts, ends)
            text, starts, ends = joined_words(part, starts, ends)
            of, base = np.arange(row, until), np.zeros(until - row, np.int64)
            if len(symbols) <= self.slice:
                yield self._units(text, symbols, starts, ends, cuts, of, base)
            else:  # one very long row
                for a in range(0, len(symbols), self.slice):
                    b = min(a + self.slice + self.window - 1, len(symbols))
                    yield self._units(text, symbols[a:b], starts[a:b], ends[a:b], np.array([0, b - a]), of, np.array([a]))
            row = until

    def _units(self, text: np.ndarray, symbols: np.ndarray, first: np.ndarray, last: np.ndarray, cuts: np.ndarray, of: np.ndarray, base: np.ndarray) -> Units:
        window = self.window
        starts, ends = cuts[:-1], cuts[1:]
        long = ends - starts >= window
        starts, ends, of, base = starts[long], ends[long], of[long], base[long]
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none.astype(np.uint64), b""
        anchor, grams = anchors(symbols, window, self.gram)
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new[starts] = True
        at = np.flatnonzero(new)
        segment = np.searchsorted(starts, at, side="right") - 1
        inside = (segment >= 0) & (at <= ends[segment] - window)
        stop = np.append(at[1:], len(symbols))[inside]
        at, segment = at[inside], segment[inside]
        n = np.minimum(stop, ends[segment] - window + 1) - at
        data = memoryview(text.tobytes())
        digests = b"".join([digest(data[a:b]) for a, b in zip(first[at].tolist(), last[at + n + window - 2].tolist(), strict=True)])
        return of[segment], at - starts[segment] + base[segment], n, anchor[at] - at, grams[anchor[at]], digests

    def cutter(self, text: np.ndarray):
        starts, ends, _ = row_words(text, np.array([0, len(text)]))
        words, starts, ends = joined_words(text, starts, ends)
        data = words.tobytes()
        return lambda start, size: data[starts[start] : ends[start + size - 1]]

    def windows(self, covered: bytes, n: int) -> list[bytes]:
        words = covered.split(b" ")
        return [b" ".join(words[i : i + self.window]) for i in range(n)]

    def repeats(self, texts: list[bytes], n: np.ndarray, lead: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of all factors of the stretches against the block that they make."""
        unit, start, words = self.factors(texts, n)
        windows = words - self.window + 1
        first = np.cumsum(windows) - windows
        return np.repeat(unit, windows), np.arange(windows.sum()) - np.repeat(first - start, windows)

    def factors(self, texts: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, first word, words) of each factor with a source, in order; of each stretch, ``n`` windows are in the index."""
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.flatnonzero(joined == 32)
        edges = np.concatenate(([0], ends + 1))
        column = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(joined))
        words = column.dictionary_encode().indices.to_numpy().astype(np.int64)
        per = n + self.window - 1  # words of each stretch
        begin = np.cumsum(per) - per
        unit = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        names = window_names(words, self.window)[begin[unit] + place]
        # The source of a window: the next place with the same name, the first one for the last.
        order = np.argsort(names, kind="stable")
        same = np.concatenate((names[order][1:] == names[order][:-1], [False]))
        head = np.flatnonzero(np.concatenate(([True], ~same[:-1])))
        source = np.full(len(names), -1, np.int64)
        source[order[:-1][same[:-1]]] = order[1:][same[:-1]]
        last = np.append(head[1:], len(order)) - 1
        many = last > head
        source[order[last[many]]] = order[head[many]]
        # A factor ends with its stretch, or where its source goes on differently; what starts after it is looked up anew.
        has = source >= 0
        goes_on = has[1:] & has[:-1] & (source[1:] == source[:-1] + 1) & (unit[1:] == unit[:-1])
        opens = np.flatnonzero(has & ~np.concatenate(([False], goes_on)))
        closes = np.flatnonzero(has & ~np.concatenate((goes_on, [False])))
        return unit[opens], place[opens], closes - opens + self.window


def remove_repeated_words(docs: DataFrame, window: int = 35, keep_text: bool = False) -> DataFrame:
    """Remove every word that a window of ``window`` words covers whose sequence also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for,
    ``kept`` (that text) and ``removed`` (the [start, end) runs of words).
    """
    method = RelativeLempelZiv(window, min(ANCHOR_WORDS, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            whole = raw.tobytes()
            starts, ends, cuts = row_words(raw, offsets)
            sizes, removed, digests, kept, runs = [], [], [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                n = int(cuts[i + 1] - cuts[i])
                gone = covered(spans, n, window) if spans else np.zeros(n, bool)
                if spans:
                    own = np.flatnonzero(~gone) + cuts[i]
                    left = b" ".join(whole[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True))
                else:
                    left = b" ".join(whole[offsets[i] : offsets[i + 1]].split())
                sizes.append(n)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left.decode())
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    runs.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns += [pa.array(kept, pa.string()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<start:long,end:long>>" * keep_text
    return with_spans(docs, method).mapInArrow(tidy(run), schema)
