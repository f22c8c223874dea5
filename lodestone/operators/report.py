"""Composed operations: intent-filtered output, batches of command output, scoped search, the discovery report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.compact import compact_label, within_budget
from lodestone.operators.indexed import cascade
from lodestone.operators.session import HINT_TEXTS, hint_list, throttle, tool_counts
from lodestone.operators.terms import distinctive_terms
from lodestone.sources.options import Options
from lodestone.sources.shared import stored
from lodestone.sources.store import Store

HINT = "\nUse search(queries: [...]) to retrieve full content of any section."


def _in_order(value: Column, order: Column) -> Column:
    """Values of a group in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def intent_filter(store: Store, outputs: DataFrame, threshold: int = 5_000, level: str = "normal", stemmed: bool = True, limit: int = 3) -> DataFrame:
    """doc_id, text: outputs up to ``threshold`` bytes as they are, larger ones as what matches their intent.

    ``outputs`` has doc_id, source, text, intent. Large outputs go into the store in one commit, and intents search all that is there.
    """
    size = F.octet_length("text")
    small = outputs.filter(size <= threshold).select("doc_id", "text")
    large = outputs.filter(size > threshold)
    queries = large.select(F.col("doc_id").alias("query_id"), F.col("intent").alias("query"), F.lit(None).cast("string").alias("source"), F.lit(limit).alias("k"))
    commit = store.index(large)
    chunks = store.snapshot().chunks.filter(F.col("commit") == commit)
    hits = stored(cascade(store, queries, stemmed), "intent")
    found = hits.withColumn("line", F.concat(F.lit("  - **"), "title", F.lit("**: "), F.substring("snippet", 1, 200), F.lit("\n")))
    matched = found.groupBy(F.col("query_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.array_join(_in_order(F.col("line"), F.col("rank")), "").alias("hits"))
    counts = chunks.groupBy(F.col("source_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("sections"))
    terms = distinctive_terms(chunks, by_source=True).groupBy(F.col("source_id").alias("doc_id")).agg(F.array_join(_in_order(F.col("word"), F.col("rank")), ", ").alias("terms"))
    joined = large.join(counts, "doc_id", "left").join(matched, "doc_id", "left").join(terms, "doc_id", "left")
    words = F.when(F.col("terms").isNotNull() & F.lit(level != "ultra"), F.concat(F.lit("\nSearchable terms: "), "terms", F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("Indexed "), F.coalesce("sections", F.lit(0)).cast("string"), F.lit(" sections from "), "source", F.lit(".\n"), F.coalesce("n", F.lit(0)).cast("string"),
        F.lit(' sections matched "'), "intent", F.lit('":\n\n'), F.coalesce("hits", F.lit("")), words, F.lit(HINT),
    )
    return small.unionByName(joined.select("doc_id", compact_label(text, level).alias("text")))


def batch_text(outputs: DataFrame) -> DataFrame:
    """batch_id, text: the outputs of a batch (batch_id, ord, label, output) as sections under their labels."""
    body = F.when(F.coalesce("output", F.lit("")) == "", "(no output)").otherwise(F.col("output"))
    section = F.concat(F.lit("## "), "label", F.lit("\n\n"), body, F.lit("\n\n"))
    return outputs.groupBy("batch_id").agg(F.array_join(_in_order(section, F.col("ord")), "").alias("text"))


#: Fixed value: what a refused call says. The lines that results and notices are made of, below, are fixed values too.
BLOCKED = "Too many search calls in quick succession. Use batch_execute instead to run commands and search in one call."


def result_blocks(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, block: the results of ``cascade`` as text, one block for each query, in order of rank."""
    text = F.concat(F.lit("\n--- ["), "label", F.lit("] ---\n### "), "title", F.lit("\n\n"), "snippet", F.lit("\n"))
    per = hits.groupBy("query_id").agg(F.array_join(_in_order(text, F.col("rank")), "").alias("found"), F.max("corrected").alias("corrected"))
    note = F.when(F.col("corrected").isNotNull(), F.concat(F.lit('(corrected to: "'), "corrected", F.lit('")\n'))).otherwise("")
    block = F.concat(F.lit("## "), "query", F.lit("\n"), note, F.coalesce("found", F.lit("No results found.\n")))
    return queries.join(per, "query_id", "left").select("query_id", block.alias("block"))


def search_calls(store: Store, calls: DataFrame, queries: DataFrame, options: Options | None = None, stemmed: bool = True) -> DataFrame:
    """call_id, calls_in_window, output: whole search calls, answered together.

    ``calls`` has call_id, ts, source, limit; ``queries`` has call_id, ord, query. The window of calls decides how many hits
    each query of a call gets, or that the call is refused. Blocks follow in order as long as those before are within the byte budget; a call
    that was cut down says so at its end.
    """
    o = options or Options()
    counted = throttle(calls, o.search_window_ms, o.search_reduce_after, o.search_block_after, o.search_limit)
    n = F.col("calls_in_window")
    k = F.when(n > o.search_reduce_after, 1).otherwise(F.least(F.coalesce("limit", F.lit(o.search_limit)), F.lit(o.search_limit)))
    counted = stored(counted.select("call_id", "calls_in_window", "source", k.cast("int").alias("k")), "calls")
    asked = queries.join(counted.filter(n <= o.search_block_after), "call_id").select(F.struct("call_id", "ord").alias("query_id"), "query", "source", "k")
    blocks = result_blocks(cascade(store, asked, stemmed), asked).select("query_id.call_id", "query_id.ord", "block")
    kept = within_budget(blocks, o.search_max_bytes, ["call_id"], ["ord"]).groupBy("call_id").agg(_in_order(F.col("block"), F.col("ord")).alias("blocks"))
    notice = F.concat(F.lit("\n⚠ Search rate limited ("), n.cast("string"), F.lit(f" calls in {o.search_window_ms / 1000:g}s). Results reduced to 1 per query."))
    parts = F.concat(F.coalesce("blocks", F.array().cast("array<string>")), F.when(n > o.search_reduce_after, F.array(notice)).otherwise(F.array().cast("array<string>")))
    return counted.join(kept, "call_id", "left").select("call_id", "calls_in_window", F.when(n > o.search_block_after, BLOCKED).otherwise(F.array_join(parts, "\n---\n\n")).alias("output"))


def discovery(chunks: DataFrame, calls: DataFrame, n_words: DataFrame) -> DataFrame:
    """One row: n_sources, n_chunks, n_words, the 20 best terms and the hints that apply. ``n_words`` is a vocabulary."""
    size = chunks.agg(F.countDistinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_chunks"))
    terms = distinctive_terms(chunks, 20).agg(F.array_join(_in_order(F.col("word"), F.col("rank")), ", ").alias("terms"))
    words = n_words.agg(F.count(F.lit(1)).alias("n_words"))
    facts = size.crossJoin(words).crossJoin(terms)  # each is one row
    usage = tool_counts(calls).crossJoin(size)
    return facts.crossJoin(usage.select(hint_list(F.col("n_sources"), F.col("n_chunks")).alias("hints")))


#: What an empty store says.
EMPTY = [
    "No content indexed yet. Use these tools to build the knowledge base:\n", "- `batch_execute` — run commands and auto-index output", "- `execute` with `intent` — auto-indexes large output",
    "- `index` — index documentation or files", "- `fetch_and_index` — fetch and index web pages",
]


def discovery_lines(store: Store, calls: DataFrame) -> DataFrame:
    """part, nth, line: the discovery report, a row for each line, in order of part and nth. Sources, latest first, are as many rows as there are."""
    spark, now = store.spark, store.snapshot()
    fixed = lambda part, lines: spark.createDataFrame([(part, i, x) for i, x in enumerate(lines)], "part int, nth long, line string")
    head = ["## Knowledge Base Discovery\n"]
    if now.n_sources:
        grams = "lazy (not yet needed)" if now.unfilled else "active"
        words = now.vocabulary.agg(F.count(F.lit(1)).alias("n"))
        head += ["| Metric | Value |", "|--------|-------|", f"| Indexed sources | {now.n_sources} |", f"| Total chunks | {now.n_chunks} |"]
        size = words.select(F.lit(2), F.lit(0).cast("long"), F.concat(F.lit("| Vocabulary size | "), F.col("n").cast("string"), F.lit(" |")))
        code = F.when(F.col("code_chunk_count") > 0, F.concat(F.lit(" ("), F.col("code_chunk_count").cast("string"), F.lit(" with code)"))).otherwise("")
        line = F.concat(F.lit("- **"), "label", F.lit("** — "), F.col("chunk_count").cast("string"), F.lit(" chunks"), code)
        listed = now.sources.orderBy(F.desc("indexed_at"), "source_id").select(F.lit(4), F.monotonically_increasing_id(), line)
        terms = distinctive_terms(now.chunks, 20).agg(F.array_join(_in_order(F.col("word"), F.col("rank")), ", ").alias("terms")).filter("terms != ''")
        best = terms.select(F.lit(5), F.lit(0).cast("long"), F.concat(F.lit("\n### Top Searchable Terms\n\n"), "terms"))
        out = fixed(1, head).union(size).union(fixed(3, [f"| Trigram index | {grams} |", "\n### Indexed Sources\n"])).union(listed).union(best)
    else:
        out = fixed(1, head + EMPTY)
    hints = tool_counts(calls).select(F.posexplode(hint_list(F.lit(now.n_sources), F.lit(now.n_chunks))).alias("nth", "hint"))
    texts = F.create_map(*(F.lit(x) for pair in HINT_TEXTS.items() for x in pair))
    return out.union(fixed(6, ["\n### Optimization Suggestions\n"])).union(hints.select(F.lit(7), F.col("nth").cast("long"), texts[F.col("hint")]))
