"""Tables shared by the two substring operators: which windows of a fixed length also start anywhere else.

Each operator cuts its windows into *units* by a method of its own: runs of window starts with one ``key``, a hash of
something that all windows of the unit hold, at ``lead`` symbols from the unit's start. Equal windows have equal keys at
equal places, whatever is around them. So:

1. Units whose key occurs nowhere else hold no repeat and go first. The others are grouped by key and by a
   128-bit BLAKE2 digest of all they cover. Units with equal digests are repeats as a whole.
2. Of units with one key and different digests, as at the ends of a shared passage, one of each sends its text to the
   key's group, where the operator finds the repeats on the text itself.
3. A key with more than ``GROUP`` different units is split: its units are cut into *parts*, about ``sqrt(window)`` windows each,
   at fixed distances from ``lead``. A part's key is a digest of the text that all its windows hold, so equal windows are
   in parts with equal keys, and 1 and 2 apply to parts. Most parts lie wholly inside or wholly outside
   of what is shared and are done with; of keys that are crowded still, windows go out one by one, dealt by digest
   and told apart in each task first.

Keys and digests that a large share of all rows has are dealt over many tasks (``spread_join``), and only counts
and one text for each different unit are grouped by key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Stage, identified, small_batches, spread_join, stored, tidy
from lodestone.llm._rolling import text_bytes

#: Different units of one key that are compared in one place.
GROUP = 512
#: Windows compared at once.
BUFFER = 1 << 19

#: Units of some rows: row, start, number of windows, lead, key (uint64), digests (16 bytes each).
Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]


class Method(Protocol):
    """What an operator says about its units."""

    window: int

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[Units]:
        """All units of concatenated rows."""

    def cutter(self, text: np.ndarray):
        """For one row: a function of (start, number of symbols) that gives their bytes."""

    def windows(self, covered: bytes, n: int) -> list[bytes]:
        """The bytes of each of a unit's windows."""

    def repeats(self, texts: list[bytes], n: np.ndarray, lead: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, window) of each window that also is one of another place in its group; units come group by group."""


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


ENTRY = ["key", "one", "two"]
UNITS = "rid long, rth long, start int, n int, lead int, key long, one long, two long"


def _emit_units(method: Method) -> Stage:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            rid, rth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "rth"))
            for row, start, n, lead, key, digests in method.units(raw, offsets):
                if len(row):
                    both = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    columns = [rid[row], rth[row], start.astype(np.int32), n.astype(np.int32), lead.astype(np.int32), key.view(np.int64), both[:, 0], both[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["rid", "rth", "start", "n", "lead", "key", "one", "two"])

    return run


OPEN = "rid long, rth long, start int, n int, lead int, single boolean, deal long, kind int, body binary"
_OPEN = pa.schema([("rid", pa.int64()), ("rth", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("lead", pa.int32()), ("single", pa.bool_()), ("deal", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
#: Kinds of rows: a unit's text, a window's digest, a window known to be a repeat, the text of a unit to be split.
TEXT, WINDOW, KNOWN, CROWDED = 0, 1, 2, 3
PARTS = "rid long, rth long, start int, n int, lead int, single boolean, key long, one long, two long, body binary"
_PARTS = pa.schema([*_OPEN][:6] + [("key", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("body", pa.binary())])


def _rows(out: list[tuple], schema: pa.Schema = _OPEN) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _number(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def _emit_open(method: Method, group: int) -> Stage:
    """The text of units to be compared or, where more than ``group`` share a key, to be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            rid, rth = (batch.column(c).to_pylist() for c in ("rid", "rth"))
            for row, units in enumerate(batch.column("units").to_pylist()):
                cut = method.cutter(raw[offsets[row] : offsets[row + 1]])
                for u in units:
                    kind = TEXT if u["variants"] <= group else CROWDED
                    out.append((rid[row], rth[row], u["start"], u["n"], u["lead"], u["single"], u["key"], kind, cut(u["start"], u["n"] - 1 + method.window)))
                if len(out) > 2000:
                    yield _rows(out)
                    out.clear()
        if out:
            yield _rows(out)

    return run


def _emit_parts(method: Method) -> Stage:
    """Units cut where the distance to ``lead`` is a multiple of ``step``; windows of one part all hold its core."""
    step = math.isqrt(method.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for u in batch.to_pylist():
                cut = method.cutter(np.frombuffer(u["body"], np.uint8))
                i = 0
                while i < u["n"]:
                    block = (u["lead"] - i) // step  # of distances block * step to block * step + step - 1
                    core = u["lead"] - block * step
                    stop = min(u["n"], core + 1)
                    body = cut(i, stop - i - 1 + method.window)
                    own = digest(body)
                    key = digest(b"%d %d " % (u["deal"], block) + cut(core, method.window - step + 1))
                    out.append((u["rid"], u["rth"], u["start"] + i, stop - i, core - i, u["single"], _number(key), _number(own), _number(own[8:]), body))
                    i = stop
            if out:
                yield _rows(out, _PARTS)

    return run


def _emit_windows(method: Method, most: int = 1 << 19) -> Stage:
    """Digests of the single windows of parts.

    Windows met more than once in one task are repeats already; of each of these digests one row leaves the task (or
    one for each ``most`` digests), so a window that a third of all rows has makes no large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        seen: dict[bytes, list] = {}  # digest: row identity, start, single, whether to be reported when met again

        def known(rid: int, rth: int, start: int) -> None:
            out.append((rid, rth, start, 1, 0, True, rid * 31 + start & 0x7FFFFFFF, KNOWN, b""))

        def leave() -> Iterator[pa.RecordBatch]:
            out.extend((rid, rth, start, 1, 0, single, _number(d), WINDOW, d) for d, (rid, rth, start, single, _) in seen.items())
            seen.clear()
            for i in range(0, len(out), 5000):
                yield _rows(out[i : i + 5000])
            out.clear()

        for batch in batches:
            for u in batch.to_pylist():
                for i, w in enumerate(method.windows(u["body"], u["n"])):
                    before = seen.setdefault(d := digest(w), here := [u["rid"], u["rth"], u["start"] + i, u["single"], u["single"]])
                    if before is here:
                        continue
                    if before[4]:
                        known(*before[:3])
                        before[4] = False
                    if u["single"]:
                        known(*here[:3])
            if len(seen) > most or len(out) > 5000:
                yield from leave()
        yield from leave()

    return run


SPANS = "rid long, rth long, start int, n int"


def _runs(rid: np.ndarray, rth: np.ndarray, start: np.ndarray, unit: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Window places (sorted by unit and place) as runs."""
    new = np.concatenate(([True], (unit[1:] != unit[:-1]) | (place[1:] != place[:-1] + 1)))
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(unit))).astype(np.int32)
    u = unit[at]
    return pa.RecordBatch.from_arrays([pa.array(rid[u]), pa.array(rth[u]), pa.array((start[u] + place[at]).astype(np.int32)), pa.array(n)], ["rid", "rth", "start", "n"])


def _resolve(method: Method, buffer: int = BUFFER) -> Stage:
    """Windows of single units that their group has once more; rows come sorted by ``deal``, groups stay whole."""

    def answer(held: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = held.column("kind").to_numpy()
        for kind in (TEXT, WINDOW, KNOWN):
            part = held.take(pa.array(np.flatnonzero(kinds == kind)))
            if not len(part):
                continue
            rid, rth, start, n, lead, deal = (part.column(c).to_numpy() for c in ("rid", "rth", "start", "n", "lead", "deal"))
            if kind == TEXT:
                group = np.cumsum(np.concatenate(([0], deal[1:] != deal[:-1])))
                unit, place = method.repeats(part.column("body").to_pylist(), n.astype(np.int64), lead.astype(np.int64), group)
            elif kind == WINDOW:
                number: dict[bytes, int] = {}
                names = np.array([number.setdefault(b, len(number)) for b in part.column("body").to_pylist()])
                unit = np.flatnonzero(np.bincount(names)[names] > 1)
                place = np.zeros(len(unit), np.int64)
            else:
                unit, place = np.arange(len(part)), np.zeros(len(part), np.int64)
            mine = part.column("single").to_numpy(zero_copy_only=False).astype(bool)[unit]
            unit, place = unit[mine], place[mine]
            if len(unit):
                order = np.lexsort((place, unit))
                yield _runs(rid, rth, start, unit[order], place[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            while batch.num_rows:
                deal = batch.column("deal").to_numpy()
                if windows >= buffer:  # up to the end of the group
                    other = np.flatnonzero(deal != held[-1].column("deal")[-1].as_py())
                    until = int(other[0]) if len(other) else len(deal)
                else:
                    ends = windows + np.cumsum(batch.column("n").to_numpy())
                    until = min(len(deal), int(np.searchsorted(ends, buffer)) + 1)
                if until:
                    held.append(batch.slice(0, until))
                    windows += int(batch.column("n").to_numpy()[:until].sum())
                    batch = batch.slice(until)
                if batch.num_rows and windows >= buffer and batch.column("deal")[0].as_py() != held[-1].column("deal")[-1].as_py():
                    yield from answer(pa.Table.from_batches(held))
                    held, windows = [], 0
        if held:
            yield from answer(pa.Table.from_batches(held))

    return run


def _told_apart(units: DataFrame, name: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of units: the different ones with one place each (``first``), keys with several, and those that come again."""
    first = F.min(F.struct("rid", "rth", "start", "n", "lead", *more)).alias("first")
    variants = stored(units.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("times"), first), f"{name}-variants")
    crowds = stored(variants.groupBy("key").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1"), f"{name}-crowds")
    return variants, crowds, stored(variants.filter("times > 1").select(*ENTRY, "times"), f"{name}-copied")


def repeated_windows(docs: DataFrame, method: Method, group: int = GROUP) -> DataFrame:
    """Per row identity, ``spans``: the runs (start, n) of window starts whose window also starts anywhere else."""
    small_batches(docs.sparkSession)
    rows = identified(docs).select("rid", "rth", "text")
    span = ["rid", "rth", "start", "n"]
    units = rows.mapInArrow(tidy(_emit_units(method)), UNITS)
    # Computing units again costs less than keeping those, most of them, whose key occurs once.
    keys = stored(units.groupBy("key").agg(F.count(F.lit(1)).alias("total")).filter("total > 1"), "keys")
    units = stored(spread_join(units, keys, ["key"], "total", "left_semi"), "units")
    variants, crowds, copied = _told_apart(units, "units")
    whole = spread_join(units, copied, ENTRY, "times", "left_semi").select(*span)
    unit = F.struct("first.start", "first.n", "first.lead", "key", (F.col("times") == 1).alias("single"), "variants").alias("unit")
    unsure = spread_join(variants, crowds, ["key"], "variants").select("first.rid", "first.rth", unit).groupBy("rid", "rth").agg(F.collect_list("unit").alias("units"))
    # One row for each text: rows that are equal in id and text give the same symbols.
    texts = stored(rows.join(unsure.hint("shuffle_hash"), ["rid", "rth"]).mapInArrow(tidy(_emit_open(method, group)), OPEN), "texts")

    parts = stored(texts.filter(F.col("kind") == CROWDED).mapInArrow(tidy(_emit_parts(method)), PARTS), "parts")
    variants, crowds, copied = _told_apart(parts, "parts", "single", "body")
    inside = spread_join(parts.filter("single").select(*span, *ENTRY), copied, ENTRY, "times", "left_semi").select(*span)
    # Parts that come again are repeats as a whole, so only the others are asked about.
    single = (F.col("first.single") & (F.col("times") == 1)).alias("single")
    unsure = spread_join(variants, crowds, ["key"], "variants").select(*(f"first.{c}" for c in [*span, "lead"]), single, F.col("key").alias("deal"), F.lit(TEXT).alias("kind"), "first.body", "variants")
    compared = texts.filter(F.col("kind") == TEXT).unionByName(unsure.filter(F.col("variants") <= group).drop("variants"))
    windows = unsure.filter(F.col("variants") > group).mapInArrow(tidy(_emit_windows(method)), OPEN)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = compared.unionByName(windows).repartition(partitions, "deal").sortWithinPartitions("deal").mapInArrow(tidy(_resolve(method)), SPANS)
    return whole.unionByName(inside).unionByName(edges).groupBy("rid", "rth").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def covered(spans: list[dict] | None, length: int, window: int) -> np.ndarray:
    """Which of ``length`` symbols some repeated window covers."""
    change = np.zeros(length + 1, np.int64)
    for s in spans or ():
        change[s["start"]] += 1
        change[s["start"] + s["n"] - 1 + window] -= 1
    return np.cumsum(change[:-1]) > 0


def with_spans(docs: DataFrame, method: Method) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) of every row, with its ``spans`` or null."""
    return identified(docs).join(repeated_windows(docs, method).hint("shuffle_hash"), ["rid", "rth"], "left").select("doc_id", "text", "spans")
