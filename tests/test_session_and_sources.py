"""Usage analytics in batch and streaming, sources, store, options, subprocesses."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import session as ss
from lodestone.sources import execute as ex
from lodestone.sources import options as op
from lodestone.sources import readers
from lodestone.sources.store import Store
from lodestone.streaming import session as st

CALLS = "call_id long, user_id long, tool string, ts timestamp, bytes_returned long, bytes_indexed long, bytes_sandboxed long"


def call_rows(seed, n):
    import datetime as dt

    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, r.randint(1, 3), r.choice(["search", "execute"]), start + dt.timedelta(milliseconds=250 * r.randint(0, 400)), r.randint(0, 5000), r.randint(0, 99), 0) for i in range(n)]


def model_throttle(rows, window, reduce_after, block_after, limit):
    held, out = {}, {}
    for call_id, user, _, ts, *_ in sorted(rows, key=lambda x: (x[3], x[0])):
        now = int(ts.timestamp() * 1000)
        q = held.setdefault(user, deque())
        q.append(now)
        while q[0] < now - window:
            q.popleft()
        n = len(q)
        out[call_id] = (n, 0 if n > block_after else 1 if n > reduce_after else limit)
    return out


def test_throttle(spark):
    rows = call_rows(1, 300)
    calls = spark.createDataFrame(rows, CALLS).repartition(3)
    got = {r.call_id: (r.calls_in_window, r.allowed) for r in ss.throttle(calls, 10_000, group=["user_id"]).collect()}
    assert got == model_throttle(rows, 10_000, 3, 8, 3)


def test_stream_throttle_and_totals(spark, tmp_path):
    rows = call_rows(2, 120)
    rows.sort(key=lambda x: (x[3], x[0]))
    path = str(tmp_path / "log")
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], CALLS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs = {"limits": (st.stream_throttle(stream, "user_id", 10_000), "append"), "sums": (st.stream_tool_stats(stream), "complete")}
    for name, (df, mode) in jobs.items():
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.call_id: (r.calls_in_window, r.allowed) for r in spark.table("limits").collect()}
    assert got == model_throttle(rows, 10_000, 3, 8, 3)
    assert {tuple(r) for r in spark.table("sums").collect()} == {(r.tool, r.calls, r.bytes_returned) for r in ss.tool_stats(spark.createDataFrame(rows, CALLS)).collect()}
    windows = st.stream_window_stats(stream, "10 seconds", "1 minute")
    q = windows.writeStream.outputMode("update").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbling").count() > 0


def test_totals_are_exact_after_a_replay_and_a_restart(spark, tmp_path):
    rows, log, totals = call_rows(5, 90), str(tmp_path / "log"), str(tmp_path / "totals")
    put = lambda part: spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(log)
    put(rows[:30])
    put(rows[30:60])

    def go():
        stream = spark.readStream.schema(spark.read.parquet(log).schema).option("maxFilesPerTrigger", 1).parquet(log)
        st.record_totals(stream, totals).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {tuple(r) for r in st.read_totals(spark, totals).collect()}

    want = lambda part: {(r.tool, r.calls, r.bytes_returned) for r in ss.tool_stats(spark.createDataFrame(part, CALLS)).collect()}
    assert go() == want(rows[:60])
    (tmp_path / "state" / "commits" / "1").unlink()  # as if the last batch had been recorded but not committed
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert go() == want(rows[:60])
    put(rows[60:])
    assert go() == want(rows)


def test_stream_throttle_forgets_and_takes_late_calls(spark, tmp_path):
    import datetime as dt

    start, log = dt.datetime(2024, 1, 1), str(tmp_path / "log")
    at = lambda s: start + dt.timedelta(seconds=s)
    batches = [[(1, "a", at(100)), (2, "a", at(104))], [(3, "a", at(102)), (4, "b", at(104))], [(5, "b", at(500))], [(6, "a", at(101)), (7, "b", at(501))], [(8, "c", at(9000))], [(9, "c", at(9001))]]
    for rows in batches:
        spark.createDataFrame(rows, "call_id long, who string, ts timestamp").coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema("call_id long, who string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(log)
    q = st.stream_throttle(stream, "who", 10_000, reduce_after=1, block_after=2, late="60 seconds").writeStream.outputMode("append").format("memory").queryName("late")
    run = q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.call_id: (r.calls_in_window, r.allowed) for r in spark.table("late").collect()}
    assert got == {1: (1, 3), 2: (2, 1), 3: (2, 1), 4: (1, 3), 5: (1, 3), 7: (2, 1), 8: (1, 3), 9: (2, 1)}  # 6 is older than the watermark
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # a and b have gone


def test_report(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(1, 1, "execute", now, 120, 500, 300), (2, 1, "execute", now, 80, 0, 0)], CALLS)
    one = ss.savings(calls).first()
    assert (one.calls, one.returned, one.kept_out, one.processed, one.ratio, one.reduction_pct) == (2, 200, 800, 1000, 5.0, 80.0)
    assert (one.tokens_returned_low, one.tokens_returned_mid, one.tokens_returned_high) == (40, 50, 67)
    assert ss.report_lines(calls).first().line == f"  {'execute':16} {2:>3} calls  {'█' * 15} 200B (~40-67 tok)"
    none = ss.savings(calls.limit(0)).first()
    assert (none.calls, none.ratio, none.reduction_pct) == (0, 1.0, 0.0)
    free = ss.savings(calls.withColumn("bytes_returned", F.lit(0))).first()
    assert free.ratio is None and free.reduction_pct == 100.0
    assert spark.range(1).select(ss.gauge(F.lit(0.8))).first()[0] == f"[{'█' * 16}{'░' * 4}] 80%"


def test_hints(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 1)
    frame = lambda tools: spark.createDataFrame([(i, 1, t, now, 1, 0, 0) for i, t in enumerate(tools)], CALLS)
    hints = lambda tools, sources, chunks: ss.suggestions(frame(tools), sources, chunks).first().hints
    assert hints([], 0, 0) == ["start with a batch"]
    assert hints(["execute"] * 4, 0, 0) == ["batch commands", "index more"]
    assert hints(["search"] * 6 + ["batch_execute"], 1, 51) == ["batch searches", "filter by source"]


def test_inventory(spark):
    out = spark.createDataFrame([("a", "x\ny\n"), ("b", ""), ("c", None)], "label string, output string")
    assert {tuple(r) for r in ss.inventory(out).collect()} == {("a", 3), ("b", 1), ("c", 1)}


def test_report_text(spark):
    import datetime as dt

    now = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(1, 1, "search", now, 120, 500, 300), (2, 1, "execute", now + dt.timedelta(seconds=5), 80, 0, 0)], CALLS)
    report = ss.report_text(calls, 65)
    text = report.first().report
    assert text.split("\n")[:5] == ["## Session Statistics", "", "| Metric | Value |", "|--------|-------|", "| Session time | 1m 5s |"]
    assert "| Est. tokens used | ~40-67 tokens (<$0.01) |\n| Est. tokens saved | ~160-267 tokens (<$0.01) |\n| **Savings ratio** | **5.0x** (80.0% reduction) |\n\n**Context savings:** [" + "█" * 16 + "░" * 4 + "] 80%\n  Sandbox: 800B kept out | Context: 200B entered\n" in text
    assert text.index("  search ") < text.index("  execute ") and text.endswith("tok)\n\nKept 800B out of context (80.0% savings).")
    again = ss.report_text(ss.with_report_call(calls, report, 3, F.lit(now + dt.timedelta(seconds=9))), 70).first().report
    size = len(text.encode())
    assert "| Tool calls | 3 |" in again and f"| Context consumed | {200 + size}B |" in again and again.index("  execute ") < again.index("  stats ")
    assert "∞" in ss.report_text(spark.createDataFrame([(1, 1, "index", now, 0, 9, 0)], CALLS)).first().report
    empty = ss.report_text(spark.createDataFrame([], CALLS)).first().report
    assert "**1.0x** (0.0% reduction)" in empty and "Breakdown" not in empty and "savings:" not in empty


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Á\n---\nb", encoding="utf-8")
    (tmp_path / "big.md").write_text("x" * 100)
    got = readers.files(spark, str(tmp_path), most=50).collect()
    assert [(r.source.endswith("a.md"), r.text) for r in got] == [(True, "# Á\n---\nb")]
    assert readers.inline(spark.createDataFrame([(1, ""), (2, "x"), (3, None), (4, "y" * 99)], "doc_id int, text string"), 50).count() == 1
    pages = spark.createDataFrame([(1, "https://e.com", "<p>a</p>"), (2, "http://10.1.1.1", "b"), (3, "ftp://e.com", "c")], "page_id long, url string, html string")
    assert [tuple(r) for r in readers.fetched(pages).collect()] == [(1, "https://e.com", "a")]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), vocabulary_limit=4)
    docs = spark.createDataFrame([(1, "a", "alpha beta gamma"), (2, "b", "# H\n```\ncode\n```\n---\nalpha delta")], "doc_id long, source string, text string")
    store.index(docs, F.lit("2024-01-01").cast("timestamp"))
    store.index(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(3).cast("long")), F.lit("2024-01-02").cast("timestamp"))
    assert tuple(store.stats().first()) == (3, 4, 4)
    assert [(r.source_id, r.label, r.chunk_count, r.code_chunk_count) for r in store.list_sources().collect()] == [(3, "a", 1, 0), (1, "a", 1, 0), (2, "b", 2, 1)]
    again = Store(spark, str(tmp_path / "store"))
    assert again.chunks.count() == 4


def test_options(tmp_path):
    assert op.load(env={}) == op.Options()
    (tmp_path / ".lodestone.json").write_text('{"compression_level": "compact", "search_limit": 9}')
    got = op.load([str(tmp_path / "none"), str(tmp_path)], {"LODESTONE_BATCH_MAX_BYTES": "500", "LODESTONE_SEARCH_BLOCK_AFTER": "1", "LODESTONE_MAX_OUTPUT_BYTES": "x"})
    assert (got.search_limit, got.max_output_bytes, got.batch_max_bytes, got.search_block_after, got.intent_search_threshold) == (9, 51_200, 1024, 4, 3_000)
    (tmp_path / ".lodestone.json").write_text('{"search_limit": "many"}')
    assert op.load([str(tmp_path)], {}) == op.Options()
    assert op.load([], {"LODESTONE_STORE_DIR": "/x"}).persist


def test_execute(spark):
    jobs = [
        (1, "python", "print('hi')", None), (2, "shell", "echo out; echo err >&2; exit 3", None), (3, "python", "import time; time.sleep(30)", None), (4, "cobol", "x", None),
        (5, "python", "print(len(FILE_CONTENT))", "abcé"), (6, "python", "while True: print('x' * 1000)", None), (7, "python", "import os; print(os.environ.get('SECRET_THING'))", None),
    ]
    frame = spark.createDataFrame(jobs, "job_id long, language string, code string, file_text string")
    results = ex.execute(frame, timeout=4, cap=50_000, parallel=4).collect()
    got = {r.job_id: r for r in results}
    assert got[1].stdout == "hi\n" and got[1].exit_code == 0
    assert (got[2].stdout, got[2].stderr, got[2].exit_code) == ("out\n", "err\n", 3)
    assert got[3].timed_out and got[3].exit_code is None
    assert "no program" in got[4].stderr and got[5].stdout == "4\n"
    assert got[6].capped and len(got[6].stdout) <= 50_000 and got[7].stdout == "None\n"
    text = {r.job_id: r.text for r in ex.result_text(spark.createDataFrame([(1, "o", "e", 0), (2, "o", "e", 1)], "job_id long, stdout string, stderr string, exit_code int")).collect()}
    assert text == {1: "o", 2: "o\ne"}


@pytest.fixture(autouse=True)
def secret(monkeypatch):
    monkeypatch.setenv("SECRET_THING", "1")
