"""Streaming call statistics, and an exact sliding-window rate limit with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_tool_stats(calls: DataFrame) -> DataFrame:
    """Running totals by tool; use output mode ``complete`` or ``update``."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes_returned").alias("bytes_returned"))


def stream_window_stats(calls: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Totals by tool and tumbling window, with a watermark for late calls."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", length), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes_returned").alias("bytes_returned"))


def record_totals(calls: DataFrame, path: str) -> DataStreamWriter:
    """Keep exact totals by tool in ``path``: a folder for each micro-batch, by its number, which a replay of the batch overwrites.

    Start it with a checkpoint location; ``read_totals`` adds up what is there.
    """

    def put(batch: DataFrame, number: int) -> None:
        stream_tool_stats(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return calls.writeStream.outputMode("append").foreachBatch(put)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """tool, calls, bytes_returned over all batches recorded so far."""
    per = spark.read.schema("tool string, calls long, bytes_returned long").parquet(path)
    return per.groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("bytes_returned").alias("bytes_returned"))


def stream_throttle(calls: DataFrame, key: str, window_ms: int = 60_000, reduce_after: int = 3, block_after: int = 8, limit: int = 3, late: str = "10 minutes") -> DataFrame:
    """Each call with the number of calls of its key in the window before it, and what it is allowed.

    A call is answered in the micro-batch that brings it, and answers are final. Calls of one micro-batch count in order of time and
    call_id. A call that comes after younger ones counts those at or before its own time; one older than the watermark is dropped.
    State by key: the times that a call which may still come can count. It goes once the watermark has passed the newest window.
    """

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = state.getCurrentWatermarkMs()
        held = np.array(state.get[0] if state.exists else [], np.int64)
        batch = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        batch = batch[batch["ts"].to_numpy("datetime64[ms]").astype(np.int64) >= passed]  # the engine itself drops by the watermark of the batch before
        new = batch["ts"].to_numpy("datetime64[ms]").astype(np.int64)
        times = np.sort(np.append(held, new))
        upto = np.searchsorted(held, new, "right") + np.arange(1, len(new) + 1)
        n = upto - np.searchsorted(times, new - window_ms, "left")
        kept = times[times >= passed - window_ms]
        state.update((kept.tolist(),))
        state.setTimeoutTimestamp(int(max(times.max(initial=0) + window_ms, passed) + 1))
        yield pd.DataFrame({key: name[0], "call_id": batch["call_id"].to_numpy(), "calls_in_window": n, "allowed": np.where(n > block_after, 0, np.where(n > reduce_after, 1, limit))})

    kind = dict(calls.dtypes)[key]
    out = f"{key} {kind}, call_id long, calls_in_window long, allowed int"
    slim = calls.select(key, F.col("call_id").cast("long").alias("call_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return slim.groupBy(key).applyInPandasWithState(run, out, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
