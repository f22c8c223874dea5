"""Exact substring dedup over bytes by prefix-free parsing.

*Parse.* A ``TRIGGER``-byte gram whose rolling hash is below an ``EVERY``-th of all hashes is a trigger. A phrase reaches from one trigger to
the end of the next, so phrases overlap by a trigger and none is a prefix of another one's suffix. What a window holds in whole
phrases depends on the window alone: equal windows, wherever they stand, hold equal phrases at equal places.

*Dictionary.* Phrases are known by their rolling hash; should two share one, they share a bucket below. A window is looked up
by one of its whole phrases, that of least hash (the rightmost of equal ones). Windows whose phrase occurs once in the corpus can't repeat. The few windows
without a whole phrase (rare in random text, less so where a line is repeated) are their own keys, in full.

*Corpus order.* Suffixes are ordered in buckets, one for each dictionary phrase: every place of the parse with that phrase
has what follows it (the parse's suffixes, sorted) and what precedes it (the dictionary's suffixes, sorted by their ends).
Neighbours in these two orders have common prefixes of known length, so at each distance before the phrase two numbers
name the window: the rank among what precedes and the rank among what follows. Windows with both ranks alike at one
distance are equal. No order over the whole corpus is put together, as that would have to be sorted in one place.

Whether strings are equal is decided on the bytes themselves or by 128-bit BLAKE2 digests.

Defined cases: null or empty text: 0 bytes, nothing removed, the sha256 of nothing. Equal rows are copies of each
other. Texts under ``window`` bytes lose nothing. Repeated or null doc_ids keep one result row for each input row.
Other columns are ignored. An empty table gives no rows.
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
from lodestone.llm._rolling import BYTE_IMAGE, Prefix, U, text_bytes

TRIGGER = 16
EVERY = 24
#: Bytes handled at once; longer texts are cut into overlapping slices.
SLICE = 1 << 18
#: Units that are ordered together, about.
TOGETHER = 1024


def ordered(parts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``parts`` within their groups, and how much each has in common with the one before (-1: none before)."""
    width = max(1, max(map(len, parts)))
    order = np.array([i for _, _, i in sorted(zip(group.tolist(), parts, range(len(parts)), strict=True))])
    table = np.frombuffer(b"".join([parts[i].ljust(width, b"\0") for i in order.tolist()]), np.uint8).reshape(len(parts), width)
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate(([-1], common))


def _least(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least name in each range first..last, the rightmost of equal ones; -1 for empty ranges."""
    out = np.full(len(first), -1, np.int64)
    some = np.flatnonzero(first <= last)
    if not len(some):
        return out
    order = np.lexsort((-np.arange(len(names)), names))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    a, b = first[some], last[some]
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    for k in range(int(level.max()) + 1):
        mine = level == k
        out[some[mine]] = order[np.minimum(rank[a[mine]], rank[b[mine] - (1 << k) + 1])]
        rank = np.minimum(rank[: max(0, len(rank) - (1 << k))], rank[1 << k :])  # now of 2 ** (k + 1) names each
    return out


def _folded(digests: list[bytes], alone: np.ndarray, at: np.ndarray, segment: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which units to keep, and their numbers of windows, so that windows without a phrase that come again in this
    slice (of a line repeated over and over, say) take few rows: each different one once, and each run of repeated
    ones once more, by its first one. These two have one digest, which makes the run a repeat."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(d, len(number)) for d in digests])
    again = np.bincount(which)[which] > 1
    first = np.zeros(len(alone), bool)
    first[np.unique(which, return_index=True)[1]] = True
    opens = again & ~np.concatenate(([False], again[:-1] & (at[alone[1:]] == at[alone[:-1]] + 1) & (segment[alone[1:]] == segment[alone[:-1]])))
    run = np.cumsum(opens) - 1
    others = np.setdiff1d(np.arange(len(at)), alone)
    keep = np.concatenate((others, alone[first], alone[opens]))
    return keep, np.concatenate((n[others], np.ones(int(first.sum()), np.int64), np.bincount(run[again], minlength=int(opens.sum()))))


@dataclass(frozen=True)
class PrefixFreeParsing:
    """Units are runs of windows that are looked up by one and the same phrase."""

    window: int
    trigger: int = TRIGGER
    every: int = EVERY
    slice: int = SLICE

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[Units]:
        row, rows = 0, len(offsets) - 1
        while row < rows:
            until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + self.slice, side="right")) - 1)
            part, edges = raw[offsets[row] : offsets[until]], offsets[row : until + 1] - offsets[row]
            if len(part) <= self.slice:
                yield self._units(part, edges[:-1], edges[1:], np.arange(row, until), np.zeros(until - row, np.int64))
            else:  # one very long row
                for a in range(0, len(part), self.slice):
                    piece = part[a : a + self.slice + self.window - 1]
                    yield self._units(piece, np.zeros(1, np.int64), np.array([len(piece)]), np.array([row]), np.array([a]))
            row = until

    def _units(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, base: np.ndarray) -> Units:
        window, size = self.window, self.trigger
        long = ends - starts >= window
        starts, ends, of, base = starts[long], ends[long], of[long], base[long]
        none = np.zeros(0, np.int64)
        if not len(starts):
            return none, none, none, none, none.astype(np.uint64), b""
        data = memoryview(raw.tobytes())
        rolling = Prefix(BYTE_IMAGE[raw])
        marks = np.flatnonzero(rolling.every(size) < U((1 << 64) // self.every))
        # The parse: phrases from each trigger to the end of the next.
        begin, end = marks[:-1], marks[1:] + size
        inside = np.searchsorted(starts, begin, side="right") - 1
        whole = (inside >= 0) & (end <= ends[np.maximum(inside, 0)]) & (end - begin <= window)
        begin, end = begin[whole], end[whole]
        names = rolling.of(begin, end)
        # The phrase of a window changes only where one begins or ends to be whole in it.
        at = np.unique(np.concatenate((starts, begin + 1, end - window)))
        segment = np.searchsorted(starts, at, side="right") - 1
        inside = (segment >= 0) & (at <= ends[segment] - window)
        at, segment = at[inside], segment[inside]
        stop = np.minimum(np.append(at[1:], len(raw)), ends[segment] - window + 1)
        phrase = _least(names, np.searchsorted(begin, at, side="left"), np.searchsorted(end, at + window, side="right") - 1)
        goes_on = np.concatenate(([False], (phrase[1:] == phrase[:-1]) & (segment[1:] == segment[:-1]) & (phrase[1:] >= 0)))
        stop = stop[np.append(np.flatnonzero(~goes_on)[1:] - 1, len(at) - 1)]
        at, segment, phrase = at[~goes_on], segment[~goes_on], phrase[~goes_on]
        # Windows without a phrase are units of their own.
        each = np.where(phrase < 0, stop - at, 1)
        shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        n = np.repeat(np.where(phrase < 0, 1, stop - at), each)
        at, segment, phrase = np.repeat(at, each) + shift, np.repeat(segment, each), np.repeat(phrase, each)
        digests = [digest(data[a:b]) for a, b in zip(at.tolist(), (at + n - 1 + window).tolist(), strict=True)]
        key, lead = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
        has = phrase >= 0
        key[has], lead[has] = names[phrase[has]], begin[phrase[has]] - at[has]
        if len(alone := np.flatnonzero(~has)):
            key[alone] = np.frombuffer(b"".join([digests[i][:8] for i in alone.tolist()]), np.uint64)
            keep, n = _folded([digests[i] for i in alone.tolist()], alone, at, segment, n)
            at, segment, key, lead = at[keep], segment[keep], key[keep], lead[keep]
            digests = [digests[i] for i in keep.tolist()]
        return of[segment], at - starts[segment] + base[segment], n, lead, key, b"".join(digests)

    def cutter(self, text: np.ndarray):
        data = text.tobytes()
        return lambda start, size: data[start : start + size]

    def windows(self, covered: bytes, n: int) -> list[bytes]:
        return [covered[i : i + self.window] for i in range(n)]

    def repeats(self, texts: list[bytes], n: np.ndarray, lead: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the two orders of each bucket: places with equal ranks before and after, at equal distance."""
        units, places, a = [], [], 0
        while a < len(texts):  # whole buckets, about ``TOGETHER`` units
            b = int(np.searchsorted(group, group[min(a + TOGETHER, len(texts)) - 1], side="right"))
            unit, place = self._in_buckets(texts[a:b], n[a:b], lead[a:b], group[a:b])
            units.append(unit + a)
            places.append(place)
            a = b
        return np.concatenate(units), np.concatenate(places)

    def _in_buckets(self, texts: list[bytes], n: np.ndarray, lead: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, far = len(texts), int(lead.max()) + 1
        distances = np.arange(far)
        before = [t[:p][::-1] for t, p in zip(texts, lead.tolist(), strict=True)]
        after = [t[p : p + self.window] for t, p in zip(texts, lead.tolist(), strict=True)]
        names = np.zeros((m, far), np.int64)
        for parts, reach in ((before, distances), (after, self.window - distances)):
            order, common = ordered(parts, group)
            # A rank is new where less is common with the one before than the window takes; so buckets never share a rank.
            rank = np.cumsum(common[:, None] < reach, axis=0)
            names[order] = names[order] * (m + 1) + rank
        unit = np.repeat(np.arange(m), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        distance = lead[unit] - place
        near = distance >= 0
        unit, place, distance = unit[near], place[near], distance[near]
        _, back, times = np.unique(names[unit, distance] * far + distance, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
        return unit[again], place[again]


def remove_repeated_bytes(docs: DataFrame, window: int = 400, keep_text: bool = False) -> DataFrame:
    """Remove every byte that a ``window``-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (the bytes left) and
    ``removed`` (the [start, end) runs).
    """
    method = PrefixFreeParsing(window, min(TRIGGER, window), min(EVERY, max(2, window // 8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            sizes, removed, runs, digests, kept, cuts = [], [], [], [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                part = raw[offsets[i] : offsets[i + 1]]
                sizes.append(len(part))
                gone = covered(spans, len(part), window) if spans else np.zeros(len(part), bool)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                left = part[~gone].tobytes() if spans else part.tobytes()
                removed.append(len(part) - len(left))
                runs.append(len(edges) // 2)
                digests.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left)
                    cuts.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns += [pa.array(kept, pa.binary()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start:long,end:long>>" * keep_text
    return with_spans(docs, method).mapInArrow(tidy(run), schema)
