"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate.

Edits keep, rerole or delete turns and insert empty ones, so that role initials read ``(s?(ua)+)?``. The least cost is found over
the subsequence of retained turns: a retained turn's cost-to-go is the least, over the next retained turn, of the turns
deleted between (a difference of prefix sums), the turns to be inserted (fixed by the two roles) and its own price and cost-to-go.
One running minimum for each role holds the best next turn, so a turn takes constant time. Among cheapest edits the audit (their
initials) that is least in ASCII is read off from the front, where each turn's cost-to-go tells which letters are still cheapest.

A conversation of any length is dealt over tasks. Turns are put in order by range; up to ``SEGMENT`` turns that are next to each
other in one partition form a segment, in which a turn is one letter. A segment gives its least costs between any two roles (4 x 4);
those of a conversation are put together from its end, which tells each segment what follows it, and each segment gives its
audit and last role for each role before it, of which a walk from the conversation's start picks one. What one task holds
of a conversation is 16 numbers for each 4,096 turns, or letters of its audit, which is one value of the result.

Order: by turn (null first), then role, then text (its first 64 characters, then its SHA-256). Turns equal in all are alike.

Defined cases: a null role or text is one blank. A null conv_id is a conversation like any other. Roles count by their first
character as it is. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import small_batches, stored, tidy

#: Turns in a segment; ordinals of a partition begin at a multiple of it.
SEGMENT_BITS = 12
SPACE, NOT_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: What a turn is to the search: one of four role initials (system, user, assistant, any other) by one of four faults.
LETTERS = "ABCDEFGHIJKLMNOP"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NONE = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns that must be inserted between a retained turn and the next one, by their roles, and after the last one.
BETWEEN = ((NONE, 0, 0, 1), (NONE, NONE, 0, 1), (NONE, NONE, 1, 0), (NONE, NONE, 0, 1))
AFTER = (0, 2, 1, 0)
NAMES = ("", "system", "user", "assistant")


@dataclass(frozen=True)
class Prices:
    """What the edits cost; ``truncated`` is added for a turn that is cut off and not deleted."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by a checksum of ``conv_id:turn``: turns dropped, emptied, without
    sentence ends, repeated, or with role user. Nulls count as one blank, but stay in conv_id and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, text, role = F.crc32(key) % 20, _blank("text"), _blank("role")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    return rows.withColumn("kind", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind")


def _blank(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _sortable(turns: DataFrame, *more: str) -> DataFrame:
    """conv_id, turn, role with the rest of the order: ``head`` and ``sha`` of the text."""
    return turns.select("conv_id", "turn", _blank("role").alias("role"), F.left(_blank("text"), F.lit(64)).alias("head"), F.unhex(F.sha2(_blank("text"), 256)).alias("sha"), _blank("text").alias("text"), *more)


ORDER = ["conv_id", "turn", "role", "head", "sha"]


def _order() -> list:
    return [F.asc_nulls_first(c) for c in ORDER]


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, ord (ascending in order), role, initial and fault (see ``FINE`` to ``TRUNCATED``) of each turn."""
    facts = _sortable(turns, F.monotonically_increasing_id().alias("tie"))
    facts = facts.withColumns({"blank": ~F.col("text").rlike(NOT_SPACE), "ended": F.col("text").rlike(rf"[.!?]{SPACE}*\z")}).drop("text")
    ranged = facts.repartitionByRange(*_order(), F.col("tie")).sortWithinPartitions(*_order())
    ordered = stored(ranged.withColumn("ord", F.monotonically_increasing_id()).drop("tie", "head"), "turns")
    firsts = ordered.groupBy("conv_id", "role", "sha").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(FINE)
    return ordered.join(firsts, "ord", "left").select("conv_id", "turn", "ord", "role", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def segments(found: DataFrame) -> DataFrame:
    """conv_id, sid (ascending in order), letters and counts of faults for each segment."""
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    letter = F.substring(F.lit(LETTERS), role * 4 + F.col("fault") + 1, F.lit(1))
    listed = F.sort_array(F.collect_list(F.struct("ord", letter.alias("letter"))))  # no more than 4,096
    counts = [F.count_if(F.col("fault") == n).alias(name) for n, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    grouped = found.groupBy("conv_id", F.shiftright("ord", SEGMENT_BITS).alias("part"))
    return grouped.agg(F.min("ord").alias("sid"), F.array_join(F.transform(listed, lambda x: x["letter"]), "").alias("letters"), *counts).drop("part")


def choices(letter: str, prices: Prices) -> list[tuple[int, str, int]]:
    """The ways to retain a turn: role it then has, edit, price."""
    role, fault = divmod(LETTERS.index(letter), 4)
    if fault in (BLANK, DUPLICATE):
        return []
    more = prices.truncated if fault == TRUNCATED else 0
    kept = [(role + 1, "K", more)] if role < 3 else []
    return kept + [(to, "R", prices.rerole + more) for to in (USER, ASSISTANT)]


def costs_to_go(letters: str, end: tuple[int, ...], prices: Prices) -> list[tuple[int, ...]]:
    """For each turn and, last, for the end: the least cost of it and all after it, by the role retained before; ``end`` is what follows the last."""
    n, best, out = len(letters), [2 * NONE] * 4, [tuple(end)]
    ways = {x: choices(x, prices) for x in set(letters)}
    none_left = n * prices.delete  # the prefix sum of deletions at the end
    for i in range(n - 1, -1, -1):
        before, after = i * prices.delete, out[-1]
        for role, _, price in ways[letters[i]]:
            best[role] = min(best[role], before + price + after[role])
        out.append(tuple(min(NONE, none_left + end[q] - before, *(BETWEEN[q][r] * prices.insert + best[r] - before for r in (SYSTEM, USER, ASSISTANT))) for q in range(4)))
    return out[::-1]


def least_edits(letters: str, to_go: list[tuple[int, ...]], role: int, prices: Prices) -> tuple[str, int]:
    """The cheapest edits that are least in ASCII, after a turn of ``role``, and the last role retained."""
    out = []
    if to_go[0][role] >= NONE:  # no way leads to the end from this role, so no audit passes here
        return "", role
    for i, letter in enumerate(letters):
        left, after = to_go[i][role], to_go[i + 1]
        if prices.delete + after[role] == left:
            out.append("D")
            continue
        ways = [("I" * BETWEEN[role][r] + edit, r) for r, edit, price in choices(letter, prices) if BETWEEN[role][r] < NONE and BETWEEN[role][r] * prices.insert + price + after[r] == left]
        edits, role = min(ways)
        out.append(edits)
    return "".join(out), role


@functools.lru_cache(maxsize=4_000)
def between_roles(letters: str, prices: Prices) -> tuple[int, ...]:
    """The least cost of a segment from each role before it to each last role retained, 4 x 4; ``NONE`` where impossible."""
    ends = [costs_to_go(letters, tuple(0 if q == last else NONE for q in range(4)), prices)[0] for last in range(4)]
    return tuple(min(NONE, ends[last][q]) for q in range(4) for last in range(4))


@functools.lru_cache(maxsize=4_000)
def audits(letters: str, end: tuple[int, ...], prices: Prices) -> tuple[list[str], list[int]]:
    """A segment's audit and last role for each role before it."""
    to_go = costs_to_go(letters, end, prices)
    both = [least_edits(letters, to_go, q, prices) for q in range(4)]
    return [a for a, _ in both], [r for _, r in both]


def illegal_pairs(letters: str) -> int:
    """Neighbours whose initials are none of su, ua, au."""
    roles = [LETTERS.index(x) // 4 for x in letters]
    return sum(p not in ((0, 1), (1, 2), (2, 1)) for p in zip(roles, roles[1:], strict=False))


def _mapped(df: DataFrame, schema: str, one) -> DataFrame:
    """``one(row)`` gives output rows; rows are passed as dicts, in small batches."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            conv = columns.pop("conv_id")
            plain = {c: x.to_pylist() for c, x in columns.items()}
            rows, at = [], []
            for i in range(batch.num_rows):
                for out in one({c: x[i] for c, x in plain.items()}):
                    rows.append(out)
                    at.append(i)
            body = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(at, pa.int32())), *body.columns], ["conv_id", *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(tidy(run), f"conv_id {kind}, {schema}")


def audited(parts: DataFrame, prices: Prices) -> DataFrame:
    """conv_id, audit, cost, illegal for each conversation of ``parts``, a stored table of segments."""

    def priced(row: dict) -> Iterator[tuple]:
        x = row["letters"]
        yield row["sid"], list(between_roles(x, prices)), illegal_pairs(x), x[0] + x[-1]

    def followed(row: dict) -> Iterator[tuple]:
        listed = row["listed"]
        ahead = [prices.insert * n for n in AFTER]
        illegal = sum(x["illegal"] for x in listed) + sum(illegal_pairs(a["ends"][1] + b["ends"][0]) for a, b in zip(listed, listed[1:], strict=False))
        for k in range(len(listed) - 1, -1, -1):
            costs = listed[k]["costs"]
            before = [min(NONE, *(costs[4 * q + r] + ahead[r] for r in range(4))) for q in range(4)]
            yield listed[k]["sid"], ahead, before[START] if k == 0 else 0, illegal if k == 0 else 0
            ahead = before

    def walked(row: dict) -> Iterator[tuple]:
        found, lasts = audits(row["letters"], tuple(row["ahead"]), prices)
        yield row["sid"], found, lasts, row["cost"], row["illegal"]

    def chosen(row: dict) -> Iterator[tuple]:
        role, out = START, []
        for x in row["listed"]:
            out.append(x["audits"][role])
            role = x["lasts"][role]
        yield "".join([*out, "I" * AFTER[role]]), row["cost"], row["illegal"]

    listed = lambda *columns: F.sort_array(F.collect_list(F.struct("sid", *columns))).alias("listed")
    costs = _mapped(parts.select("conv_id", "sid", "letters"), "sid long, costs array<long>, illegal long, ends string", priced)
    ahead = _mapped(costs.groupBy("conv_id").agg(listed("costs", "illegal", "ends")), "sid long, ahead array<long>, cost long, illegal long", followed)
    met = parts.select("conv_id", "sid", "letters").join(ahead.drop("conv_id"), "sid")
    walks = _mapped(met, "sid long, audits array<string>, lasts array<int>, cost long, illegal long", walked)
    whole = walks.groupBy("conv_id").agg(listed("audits", "lasts"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    return _mapped(whole, "audit string, cost long, illegal long", chosen)


def edited(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text: the edits of ``found`` (conv_id, audit) applied. In each partition conversations follow one
    another whole and in order; deleted turns are there with edit D, inserted ones have no turn.

    A conversation's audit goes before its turns and is all that is held of it; its turns stream by, so one task reads them.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    when = turns.schema["turn"].dataType.simpleString()
    header = found.select("conv_id", F.lit(None).cast(when).alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("head", "string"), ("sha", "binary"), ("text", "string"))), "audit")
    rows = _sortable(turns).withColumn("audit", F.lit(None).cast("string")).unionByName(header)
    streamed = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("audit").isNull(), *_order()[1:])
    schema = f"conv_id {kind}, edit string, turn {when}, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, at, spoken = "", 0, 0
        for batch in batches:
            out = []
            for i, (role, text, audit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("role", "text", "audit")), strict=True)):
                if audit is not None:
                    letters, at, spoken = audit, 0, 0
                else:
                    edit = letters[at]
                    at += 1
                    if edit == "R":
                        role = NAMES[USER + spoken % 2]
                    out.append((i, edit, True, role, text))
                    spoken += edit == "R" or edit == "K" and role[0] != "s"
                while letters[at : at + 1] == "I":  # they stand before the next turn that stays
                    out.append((i, "I", False, NAMES[USER + spoken % 2], ""))
                    at, spoken = at + 1, spoken + 1
            if out:
                at_row, edits, own, roles, texts = zip(*out, strict=True)
                take = pa.array(at_row, pa.int32())
                conv, when_said = batch.column("conv_id").take(take), batch.column("turn").take(pa.array([a if o else None for a, o in zip(at_row, own, strict=True)], pa.int32()))
                yield pa.RecordBatch.from_arrays([conv, pa.array(edits), when_said, pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "edit", "turn", "role", "text"])

    return streamed.drop("head", "sha").mapInArrow(tidy(run), schema)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of the lines ``role:text`` of each conversation of ``edited`` without deleted turns."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            conv, done, where = batch.column("conv_id"), [], []
            ids = conv.to_pylist()
            for i, (one, role, text) in enumerate(zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if state is not None and one == last[0]:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append(state.hexdigest())
                        where.append(last[0])
                    state, last = hashlib.sha256(), (one,)
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(where, conv.type), pa.array(done, pa.string())], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], conv.type), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return repaired.filter("edit != 'D'").select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, prices: Prices | None = None) -> tuple[DataFrame, DataFrame]:
    """Of (conv_id, turn, role, text): one row for each conversation (conv_id, blank, duplicate, truncated, illegal, cost, audit), and
    its edited turns (see ``edited``)."""
    small_batches(turns.sparkSession)
    prices = prices or Prices()
    parts = stored(segments(faults(turns)), "turn-segments")
    found = stored(audited(parts, prices), "audits")
    counts = parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    both = counts.join(found.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    return both.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), edited(turns, found)


def repair_damaged(conversations: DataFrame, prices: Prices | None = None) -> DataFrame:
    """``damage`` undone: a row for each conv_id, with gaps in its turns, counts, cost, audit and the digest of what is repaired.

    A conversation of which nothing is left has zeros, an empty audit and the digest of no text.
    """
    slim = conversations.select("conv_id", "turn", "role", "text")
    turns = damage(slim)
    summary, after = repair(turns, prices)
    numbers = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = turns.groupBy("conv_id").agg(F.coalesce(numbers, F.lit(0)).cast("long").alias("gaps"))
    every = slim.select("conv_id").distinct()
    one = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [every, gaps, summary, digests(after)])
    zero = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256().hexdigest())
    return one.groupBy("conv_id").agg(*zero, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), none).alias("repaired_sha256"))
