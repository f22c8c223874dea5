"""Output compaction: identical runs, grouped errors, head and tail within a byte budget."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import format_bytes, js_trim, let, lines
from lodestone.sources.shared import stored

_ANY = "[^\\n\\r\\u2028\\u2029]"
#: Fixed value: lines that are grouped, as prefix, message and line number. The notes below are fixed values too.
ERROR = f"(?i)\\A({_ANY}*?(?:error|warning|ERR|WARN)[:\\s])\\s*({_ANY}+?)(?:\\s+(?:at|in|on)\\s+(?:line\\s+)?([0-9]+))?\\z"


def collapse_runs(text: Column) -> Column:
    """Runs of three or more equal non-blank lines become the line and a count."""

    def rewritten(ls: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i) != F.get(ls, i - 1)) | (js_trim(F.get(ls, i - 1)) == ""))

        def group(at: Column) -> Column:
            def one(start: Column, j: Column) -> Column:
                count = F.coalesce(F.get(at, j + 1), F.size(ls)) - start
                line = F.get(ls, start)
                note = F.concat(F.lit("  ... (×"), count.cast("string"), F.lit(" identical lines)"))
                return F.when(count > 2, F.array(line, note)).otherwise(F.array_repeat(line, count))

            return F.array_join(F.flatten(F.transform(at, one)), "\n")

        return F.when(F.size(ls) < 3, F.array_join(ls, "\n")).otherwise(let(starts, group))

    return let(lines(text), rewritten)


def group_errors(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and the text with like error and warning lines grouped at its end.

    Applies to texts of five or more lines with four or more such lines of which some are alike.
    """
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    each = base.select("k", F.posexplode(lines(F.col("t"))).alias("pos", "line"))
    part = lambda n: F.regexp_extract("line", ERROR, n)
    each = each.withColumn("hit", F.col("line").rlike(ERROR)).withColumns({"prefix": js_trim(part(1)), "message": js_trim(part(2)), "at": part(3)})
    where = F.sort_array(F.collect_list(F.when(F.col("at") != "", F.struct("pos", "at"))))
    groups = each.filter("hit").groupBy("k", "prefix", "message").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.transform(where, lambda x: x["at"]).alias("places"))
    head = F.concat_ws(" ", "prefix", "message")
    single = F.concat(head, F.when(F.size("places") > 0, F.concat(F.lit(" at line "), F.get("places", F.lit(0)))).otherwise(""))
    many = F.concat(head, F.lit(" (×"), F.col("n").cast("string"), F.lit(")"), F.when(F.size("places") > 0, F.concat(F.lit(" [lines: "), F.array_join("places", ", "), F.lit("]"))).otherwise(""))
    shown = groups.select("k", "n", F.struct("first", F.when(F.col("n") == 1, single).otherwise(many).alias("line")).alias("g"))
    per_doc = shown.groupBy("k").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("kinds"), F.transform(F.sort_array(F.collect_list("g")), lambda g: g["line"]).alias("grouped"))
    rest = F.filter(lines(F.col("t")), lambda line: ~line.rlike(ERROR))
    title = F.concat(F.lit("── Grouped errors/warnings ("), F.col("hits").cast("string"), F.lit(" → "), F.col("kinds").cast("string"), F.lit(") ──"))
    useful = (F.size(lines(F.col("t"))) >= 5) & (F.col("hits") >= 4) & (F.col("kinds") < F.col("hits"))
    joined = base.join(per_doc, "k", "left")
    return joined.select(F.col("k").alias(key), F.when(useful, F.array_join(F.concat(rest, F.array(F.lit(""), title), F.col("grouped")), "\n")).otherwise(F.col("t")).alias(text))


def truncate_middle(text: Column, most: int = 102_400) -> Column:
    """Whole lines from the head (60 %) and the tail of a text longer than ``most`` bytes, with a note between."""
    head_room = most * 6 // 10
    tail_room = most - head_room
    state = "struct<bytes:long,n:int,open:boolean>"
    zero = F.from_json(F.lit('{"bytes":0,"n":0,"open":true}'), state)

    def take(room: int):
        def step(s: Column, line: Column) -> Column:
            size = (F.octet_length(line) + 1).cast("long")
            fits = s["open"] & (s["bytes"] + size <= room)
            return F.when(fits, F.struct((s["bytes"] + size).alias("bytes"), (s["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(s["bytes"].alias("bytes"), s["n"].alias("n"), F.lit(False).alias("open"))).cast(state)

        return step

    def cut(ls: Column) -> Column:
        def with_head(head: Column) -> Column:
            rest = F.reverse(F.slice(ls, head["n"] + 1, F.greatest(F.size(ls) - head["n"], F.lit(0))))

            def render(tail: Column) -> Column:
                dropped = F.size(ls) - head["n"] - tail["n"]
                gone = F.octet_length(F.array_join(ls, "\n")) - head["bytes"] - tail["bytes"]
                note = F.concat(
                    F.lit("\n... ["), dropped.cast("string"), F.lit(" lines / "), format_bytes(gone), F.lit(" truncated — showing first "), head["n"].cast("string"),
                    F.lit(" + last "), tail["n"].cast("string"), F.lit(" lines] ...\n"),
                )
                return F.concat(F.array_join(F.slice(ls, F.lit(1), head["n"]), "\n"), note, F.array_join(F.slice(ls, F.size(ls) - tail["n"] + 1, tail["n"]), "\n"))

            return let(F.aggregate(rest, zero, take(tail_room)), render)

        return let(F.aggregate(ls, zero, take(head_room)), with_head)

    return F.when(F.octet_length(text) <= most, text).otherwise(let(lines(text), cut))


def compact(docs: DataFrame, key: str, text: str = "text", gate: int = 10_000, most: int = 102_400, capped: Column | None = None, hard_cap: int = 100 * 1024 * 1024) -> DataFrame:
    """The whole chain: notice of a hard cap, runs and errors for texts over ``gate`` characters, truncation; and ``truncated``."""
    start = docs.select(key, F.col(text).alias(text) if capped is None else capped_notice(F.col(text), capped, hard_cap).alias(text))
    large = F.char_length(text) > gate
    small, big = start.filter(~large), start.filter(large).withColumn(text, collapse_runs(F.col(text)))
    both = small.unionByName(group_errors(big, key, text))
    return both.select(key, truncate_middle(F.col(text), most).alias(text), (F.octet_length(text) > most).alias("truncated"))


def capped_notice(text: Column, killed: Column, cap: int) -> Column:
    """The text with a notice if its producer was stopped at ``cap`` bytes."""
    return F.when(killed, F.concat(text, F.lit("\n[output capped at "), format_bytes(F.lit(cap)), F.lit(" — process killed]"))).otherwise(text)


def within_budget(blocks: DataFrame, most: int, group: list[str], order: list[str], block: str = "block") -> DataFrame:
    """Blocks in order up to the first that finds the budget already exceeded; one may overshoot it."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.octet_length(block)).over(before), F.lit(0))
    return blocks.withColumn("bytes_before", used).filter(F.col("bytes_before") <= most)


def long_list_within_budget(blocks: DataFrame, most: int, group: list[str], order: list[str], block: str = "block") -> DataFrame:
    """``within_budget`` for lists of any length: none is put in order by one task.

    Sizes alone are dealt by ranges of the order. The total of each range gives the bytes before the next, so that ranges beyond the
    budget are left out and the others find the last row within it. Only rows up to there, the budget and a block at most, are
    then taken with their texts.
    """
    if not group:
        return long_list_within_budget(blocks.withColumn("__one", F.lit(0)), most, ["__one"], order, block).drop("__one")
    keys = [*group, *order]
    ranged = blocks.select(*keys, F.octet_length(block).cast("long").alias("size")).repartitionByRange(*(F.asc_nulls_first(k) for k in keys))
    dealt = stored(ranged.withColumn("part", F.spark_partition_id()), "sizes")
    totals = dealt.groupBy(*group, "part").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("total").over(earlier), F.lit(0))).filter(F.col("start") <= most).drop("total")
    aside = lambda df, names: df.select(*(F.col(k).alias(f"__{k}") if k in names else k for k in df.columns))
    same = lambda names: functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in names))
    near = dealt.join(aside(starts, [*group, "part", "start"]), same([*group, "part"]))
    inside = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = near.withColumn("before", F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).filter(F.col("before") <= most)
    ends = kept.groupBy(*group).agg(F.max(F.struct(*order)).alias("__end"))
    upto = blocks.join(aside(ends, group), same(group) & (F.struct(*order) <= F.col("__end"))).select(*blocks.columns)
    return within_budget(upto, most, group, order, block)


def compact_label(text: Column, level: str) -> Column:
    """Hints in a result text, shortened by compression level."""
    if level == "ultra":
        out = F.replace(text, F.lit("**"), F.lit(""))
        out = F.regexp_replace(out, r"(?m)Use search\(queries: \[\.\.\.]\) to retrieve.*$", "→ search() for more")
        return F.regexp_replace(out, r"(?m)Searchable terms: .+$", "")
    if level == "compact":
        return F.regexp_replace(text, r"(?s)\A(.*?)Use search\(queries: \[\.\.\.]\) to retrieve full content of any section\.", "$1→ search() for details")
    return text
