"""Tables in the folder that driver and executors share, and files made there in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED_DIR = "/tmp/checkpoints/lodestone"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, removed when the application ends in order.

    Where that is unset, a folder of this machine serves if all executors run on it, and anything else is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = LOCAL_SHARED_DIR
    path = f"{folder.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; cuts plan and lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Put a small file into ``folder``: it is written under a hidden name and appears whole, by a rename, or not at all."""
    files, hidden = _files(spark, f"{folder}/.{name}")
    out = files.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(hidden, _files(spark, f"{folder}/{name}")[1]):
        raise OSError(f"{name} could not be put into {folder}")


def make_folder(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.mkdirs(at)


def file_mark(df: DataFrame) -> int:
    """A number that changes when the files of a table do: their paths, sizes and times, by the scan's metadata."""
    seen = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return seen.agg(F.coalesce(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time") % (1 << 40)), F.lit(0))).first()[0]


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
