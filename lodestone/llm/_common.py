"""Helpers shared by the training-data operators: shared scratch tables, row identity, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Used only when the session names no ``spark.checkpoint.dir`` (tests on one machine).
LOCAL_SHARED_DIR = "/tmp/checkpoints/lodestone"
#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch; with texts of some kB a batch stays at a few MB.
ARROW_ROWS = 200
#: See ``spread_join``.
HOT_KEYS, LEAST_HOT, SALTS = 10_000, 200, 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a folder of
    this machine serves if all executors run on it, and anything else is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = LOCAL_SHARED_DIR
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, so a lost executor costs no recomputation.

    Results are read from these tables later on, so they stay until the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the cluster's file system remove a folder when the application ends in order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, a stored table with one row for each key and the number of its rows in ``left`` as ``weight``.

    Keys with more than a ``HOT_KEYS``-th of all rows are fewer than ``HOT_KEYS``, so they can be broadcast. Their rows
    are dealt over ``SALTS`` places, and their rows in ``right`` are repeated for each place.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) > max(total / HOT_KEYS, LEAST_HOT)
    hot = right.filter(heavy).select(*on).withColumn("__hot", F.lit(True))
    flagged = left.join(F.broadcast(hot), on, "left")
    place = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(0)
    places = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = right.withColumn("__place", F.explode(places.cast("array<long>")))
    return flagged.withColumn("__place", place.cast("long")).drop("__hot").join(salted, [*on, "__place"], how).drop("__place")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_sent", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(), "lodestone_package.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for f in sorted(top.rglob("*.py")):
            packed.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    context._lodestone_sent = True


def small_batches(spark: SparkSession) -> None:
    """For stages in Python: their code is sent, and a batch of very long texts is kept within a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def tidy(run: Stage) -> Stage:
    """An Arrow stage that gives its worker's freed memory back at the end of each partition."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every platform has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the row's identity ``(rid, rth)``.

    The identity is the doc_id with a hash of the text, so it is the same in every pass over the input,
    however it is partitioned. Rows equal in both columns share it, and every result of them is the same.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("rid"), F.xxhash64(F.col("doc_id"), text).alias("rth"), *more
    )


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
