"""Usage analytics over a log of tool calls, and the sliding-window rate limit in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import format_bytes


def tool_stats(calls: DataFrame) -> DataFrame:
    """Per tool: calls, bytes_returned, and its bytes as a share of the greatest."""
    per = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes_returned").alias("bytes_returned"))
    most = F.max("bytes_returned").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("share_of_most", F.when(most > 0, F.col("bytes_returned") / most).otherwise(0.0))


def _half_up(n: Column, by: int) -> Column:
    return F.floor((2 * n + by) / (2 * by)).cast("long")


def savings(calls: DataFrame) -> DataFrame:
    """One row: total calls and bytes, what was kept out, ratio (null: without bound), reduction in percent, token estimates."""
    total = calls.agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("bytes_returned"), F.lit(0)).alias("returned"),
        F.coalesce(F.sum(F.coalesce("bytes_indexed", F.lit(0)) + F.coalesce("bytes_sandboxed", F.lit(0))), F.lit(0)).alias("kept_out"),
    ).withColumn("processed", F.col("kept_out") + F.col("returned"))
    ratio = F.when(F.col("returned") > 0, F.col("processed") / F.col("returned")).when(F.col("kept_out") > 0, F.lit(None).cast("double")).otherwise(1.0)
    percent = F.when(F.col("processed") > 0, F.round((1 - F.col("returned") / F.col("processed")) * 100, 1)).otherwise(0.0)
    tokens = {f"tokens_{what}_{name}": _half_up(F.col(what), by) for what in ("returned", "kept_out") for name, by in (("low", 5), ("mid", 4), ("high", 3))}
    return total.withColumns({"ratio": ratio, "reduction_pct": percent} | tokens)


def bar(share: Column, width: int) -> Column:
    """A bar of at least one cell."""
    return F.repeat(F.lit("█"), F.greatest(F.lit(1), F.floor(share * width + 0.5).cast("int")))


def gauge(ratio: Column, width: int = 20) -> Column:
    """A framed bar with a percentage."""
    filled = F.floor(ratio * width + 0.5).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled), F.lit("] "), F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%"))


def report_lines(calls: DataFrame) -> DataFrame:
    """tool, line: the breakdown by tool as text."""
    pad = lambda c, n, right: F.when(F.char_length(c) >= n, c).otherwise((F.rpad if right else F.lpad)(c, n, " "))
    line = F.concat(
        F.lit("  "), pad(F.col("tool"), 16, True), F.lit(" "), pad(F.col("calls").cast("string"), 3, False), F.lit(" calls  "), bar(F.col("share_of_most"), 15), F.lit(" "),
        format_bytes(F.col("bytes_returned")), F.lit(" (~"), F.format_number(_half_up(F.col("bytes_returned"), 5), 0), F.lit("-"), F.format_number(_half_up(F.col("bytes_returned"), 3), 0), F.lit(" tok)"),
    )
    return tool_stats(calls).select("tool", line.alias("line"))


def _cost(tokens: Column, price: float) -> Column:
    """What tokens cost at a price for a million; small amounts as such."""
    dollars = tokens / 1_000_000 * price
    return F.when(dollars < 0.01, "<$0.01").otherwise(F.format_string("~$%.2f", dollars))


def report_text(calls: DataFrame, elapsed_s: int = 0, price: float = 3.0) -> DataFrame:
    """One row, ``report``: the statistics of a session as markdown, tools in the order of their first calls. Its wording is fixed values."""
    number = lambda c: F.format_number(c, 0)
    span = lambda what: F.concat(F.lit("~"), number(F.col(f"tokens_{what}_low")), F.lit("-"), number(F.col(f"tokens_{what}_high")), F.lit(" tokens ("), _cost(F.col(f"tokens_{what}_mid"), price), F.lit(")"))
    percent, times = F.format_string("%.1f", "reduction_pct"), F.coalesce(F.format_string("%.1fx", "ratio"), F.lit("∞"))
    times = F.when(F.col("ratio").isNull(), "∞").otherwise(times)
    rows = {
        "Session time": F.lit(f"{elapsed_s // 60}m {elapsed_s % 60}s"), "Tool calls": F.col("calls").cast("string"), "Total data processed": format_bytes(F.col("processed")), "Kept in sandbox": format_bytes(F.col("kept_out")),
        "Context consumed": format_bytes(F.col("returned")), "Est. tokens used": span("returned"), "Est. tokens saved": span("kept_out"), "**Savings ratio**": F.concat(F.lit("**"), times, F.lit("** ("), percent, F.lit("% reduction)")),
    }
    table = [F.lit("## Session Statistics\n"), F.lit("| Metric | Value |"), F.lit("|--------|-------|"), *(F.concat(F.lit(f"| {name} | "), value, F.lit(" |")) for name, value in rows.items())]
    shares = F.concat(F.lit("\n**Context savings:** "), gauge(F.col("kept_out") / F.col("processed")), F.lit("\n  Sandbox: "), format_bytes(F.col("kept_out")), F.lit(" kept out | Context: "), format_bytes(F.col("returned")), F.lit(" entered"))
    first = calls.groupBy("tool").agg(F.min(F.struct("ts", "call_id")).alias("first"))
    tools = report_lines(calls).join(first, "tool").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "line"))), lambda x: x["line"]), "\n").alias("tools"))
    lines = F.array(*table, F.when(F.col("processed") > 0, shares), F.when(F.col("calls") > 0, F.concat(F.lit("\n## Per-Tool Breakdown\n\n"), "tools")), F.concat(F.lit("\nKept "), format_bytes(F.col("kept_out")), F.lit(" out of context ("), percent, F.lit("% savings).")))
    return savings(calls).crossJoin(tools).select(F.array_join(F.array_compact(lines), "\n").alias("report"))  # each is one row


def with_report_call(calls: DataFrame, report: DataFrame, call_id: int, at: Column) -> DataFrame:
    """The log after a report was given: its own bytes are in it from the next report on."""
    own = report.select(F.lit(call_id).cast("long").alias("call_id"), F.lit("stats").alias("tool"), at.alias("ts"), F.octet_length("report").cast("long").alias("bytes_returned"))
    return calls.unionByName(own, allowMissingColumns=True)


def throttle(calls: DataFrame, window_ms: int = 60_000, reduce_after: int = 3, block_after: int = 8, limit: int = 3, group: list[str] | None = None) -> DataFrame:
    """Each call with the number of calls in its window (itself too; blocked ones count), and what it is allowed.

    Calls of one instant count one after the other, by ``call_id``. The window is a range over milliseconds, less the
    later calls of the same instant.
    """
    group = group or []
    ms = calls.withColumn("ms", F.expr("unix_millis(ts)"))
    span = Window.partitionBy(*group).orderBy("ms").rangeBetween(-window_ms, 0)
    same = Window.partitionBy(*group, "ms").orderBy(F.col("call_id").desc())
    counted = ms.withColumn("calls_in_window", F.count(F.lit(1)).over(span) - (F.row_number().over(same) - 1))
    n = F.col("calls_in_window")
    allowed = F.when(n > block_after, 0).when(n > reduce_after, 1).otherwise(limit)
    notice = F.when(n > block_after, "blocked").when(n > reduce_after, "reduced")
    return counted.withColumns({"allowed": allowed, "notice": notice}).drop("ms")


def tool_counts(calls: DataFrame) -> DataFrame:
    """One row: all calls, and those of the tools that the hints look at."""
    of = lambda t: F.coalesce(F.sum((F.col("tool") == t).cast("long")), F.lit(0))
    return calls.agg(F.count(F.lit(1)).alias("n"), of("search").alias("search"), of("execute").alias("execute"), of("batch_execute").alias("batch"))


def hint_list(n_sources: Column, n_chunks: Column) -> Column:
    """The usage hints that apply to a row of ``tool_counts`` and the size of the store."""
    some = F.col("n") > 0
    rules = [
        (~some, "start with a batch"),
        (some & (F.col("execute") > 3) & (F.col("batch") == 0), "batch commands"),
        (some & (F.col("search") > 5), "batch searches"),
        (some & (n_chunks > 50), "filter by source"),
        (some & (n_sources == 0) & (F.col("n") > 2), "index more"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


#: The hints in full.
HINT_TEXTS = {
    "start with a batch": "- Start by using `batch_execute` to run multiple commands at once",
    "batch commands": "- **Use batch_execute** — you've made multiple execute calls that could be batched into one",
    "batch searches": "- **Batch your searches** — pass multiple queries in a single search() call",
    "filter by source": "- **Use source filtering** — scope searches with `source` parameter for faster, targeted results",
    "index more": "- **Index more content** — use `intent` parameter in execute calls to auto-index large output",
}


def suggestions(calls: DataFrame, n_sources: int, n_chunks: int) -> DataFrame:
    """One row: the usage hints that apply."""
    return tool_counts(calls).select(hint_list(F.lit(n_sources), F.lit(n_chunks)).alias("hints"))


def inventory(outputs: DataFrame) -> DataFrame:
    """label, line_count of each command output; an empty one counts as one line."""
    text = F.when(F.coalesce("output", F.lit("")) == "", "(no output)").otherwise(F.col("output"))
    return outputs.select("label", F.size(F.split(text, "\n", -1)).alias("line_count"))
