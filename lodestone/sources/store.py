"""The stored index: chunks, postings, stems, vocabulary and, once asked for, trigram postings, in one folder.

Each ``index`` call writes the tables of one commit into folders of its own and then publishes one small file in ``log`` that names it,
with the commit's totals. A reader lists the log once and reads only what it names: a commit is seen whole or not at all, whichever
write failed before. Log files have names of their own, so writers never wait for or overwrite each other.

Tables are split by ``bucket`` (a hash of token, stem or gram); a query opens the buckets of what it asks for.
Trigram postings are made when substrings are first searched, for the commits that have none yet, and published alike.
A source is told apart by its commit and doc_id, so the same doc_id or label may be indexed again.
"""

from __future__ import annotations

import functools
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import indexed
from lodestone.operators.chunk import chunk
from lodestone.operators.fuzzy import vocabulary
from lodestone.sources.shared import make_folder, publish, stored

SOURCES = "commit long, source_id long, label string, chunk_count long, code_chunk_count long, indexed_at timestamp"
CHUNKS = "commit long, source_id long, label string, chunk_ord int, title string, content string, content_type string, dl int, gl int, cid long"
VOCABULARY = "commit long, word string, first_doc long, first_pos int"
POSTINGS = "commit long, source_id long, chunk_ord int, cid long, token string, dl int, weighted double, title_pos array<int>, content_pos array<int>, bucket int"
STEMS = "commit long, stem string, token string, bucket int"
PEAKS = "commit long, token string, block long, most double, shortest int, bucket int"
GRAMS = "commit long, gram string, block long, places array<int>, bucket int"
#: A bucket is shared by one task more for so many chunks, so that what a task sorts does not grow with the commit.
CHUNKS_IN_PART, CHUNKS_IN_TASK = 40_000, 5_000
ENTRY = "folder string, kind string, commit long, at long, n_chunks long, n_tokens long, n_grams long, n_sources long"


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` as they are; those that come in fewer parts than there are cores, such as one small file, dealt out first."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, F.xxhash64("doc_id", "text"))


class Snapshot:
    """What the log named at one time. Reads the same rows however many commits follow."""

    def __init__(self, store: Store, entries: list[dict]):
        self.store, self.entries = store, [e for e in entries if e["kind"] == "commit"]
        filled = {e["commit"]: e for e in sorted((e for e in entries if e["kind"] == "grams"), key=lambda e: e["folder"], reverse=True)}
        self.filled = [filled[e["commit"]] for e in self.entries if e["commit"] in filled]
        self.unfilled = [e for e in self.entries if e["commit"] not in filled]
        total = lambda name: sum(e[name] for e in self.entries)
        self.n_chunks, self.n_tokens, self.n_grams, self.n_sources = total("n_chunks"), total("n_tokens"), total("n_grams"), total("n_sources")

    def _table(self, name: str, schema: str, entries: list[dict] | None = None) -> DataFrame:
        spark, found = self.store.spark, self.entries if entries is None else entries
        top, names = f"{self.store.path}/{name}", [c.split()[0] for c in schema.split(", ")]
        paths = [f"{top}/{e['folder']}" for e in found]
        return spark.read.schema(schema).option("basePath", top).parquet(*paths).select(names) if paths else spark.createDataFrame([], schema)

    @property
    def sources(self) -> DataFrame:
        return self._table("sources", SOURCES)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    @property
    def vocabulary(self) -> DataFrame:
        """word, first_doc, first_pos: each word as the first commit with it has it, the first ``vocabulary_limit`` only."""
        order = {e["commit"]: i for i, e in enumerate(self.entries)}
        words = self._table("vocabulary", VOCABULARY).withColumn("nth", F.lit(0))
        if len(order) > 1:
            nth = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("commit")]
            words = words.groupBy("word").agg(F.min(F.struct(nth.alias("nth"), "first_doc", "first_pos")).alias("x")).select("word", "x.*")
        limit = self.store.vocabulary_limit
        return (words if limit is None else words.orderBy("nth", "first_doc", "first_pos").limit(limit)).select("word", "first_doc", "first_pos")

    def _in_buckets(self, table: DataFrame, asked: DataFrame, column: str) -> DataFrame:
        """The rows in the buckets of what is asked for: of those there are no more than ``buckets``."""
        kinds = [r[0] for r in asked.select(indexed.bucket(F.col(column), self.store.buckets)).distinct().collect()]
        return table.filter(F.col("bucket").isin(kinds) if kinds else F.lit(False)).drop("bucket")

    def postings_of(self, wanted: DataFrame) -> DataFrame:
        return self._in_buckets(self._table("postings", POSTINGS), wanted, "token")

    def stems_like(self, wanted: DataFrame) -> DataFrame:
        """stem, token: the tokens with a stem that is asked for."""
        return self._in_buckets(self._table("stems", STEMS), wanted, "stem").join(wanted.select("stem").distinct(), "stem", "left_semi").select("stem", "token").distinct()

    def peaks_of(self, wanted: DataFrame) -> DataFrame:
        """The peaks of single tokens that are asked for; empty where none is frequent."""
        single = wanted.filter("phrase_len = 1").select("token").distinct()
        return self._in_buckets(self._table("peaks", PEAKS), single, "token").join(single, "token", "left_semi")

    def grams_of(self, asked: DataFrame) -> DataFrame:
        if self.unfilled:
            raise ValueError("some commits have no trigram postings; take Store.with_grams()")
        return self._in_buckets(self._table("grams", GRAMS, self.filled), asked, "gram")


class Store:
    """A folder with a store. ``buckets`` and ``parts`` (tasks that share a bucket) are those of the commits written through it; all
    writers and readers of a folder take the same ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, vocabulary_limit: int | None = 10_000, buckets: int = 16, parts: int = 4):
        self.spark, self.path, self.vocabulary_limit, self.buckets, self.parts = spark, path.rstrip("/"), vocabulary_limit, buckets, parts
        make_folder(spark, f"{self.path}/log")

    def snapshot(self) -> Snapshot:
        """What is committed now, in the order of commits."""
        found = [r.asDict() for r in self.spark.read.schema(ENTRY).json(f"{self.path}/log").collect()]
        return Snapshot(self, sorted(found, key=lambda e: (e["at"], e["commit"])))

    def index(self, docs: DataFrame, at: Column | None = None) -> int:
        """Commit ``docs`` (doc_id, source, text); the number of the commit. Null texts have no chunks and list no source."""
        docs = spread(docs)
        commit = uuid.uuid4().int >> 66
        folder = f"commit={commit}"
        put = functools.partial(self._put, folder)
        put(indexed.measured(chunk(docs, "source")), "chunks", CHUNKS)
        chunks = self._own(folder, "chunks", CHUNKS)
        size = chunks.count()
        tasks = max(self.spark.sparkContext.defaultParallelism, size // CHUNKS_IN_TASK)  # each writes to all buckets, so no more than that
        put(indexed.postings(chunks.repartition(tasks, F.shiftright("cid", indexed.PEAK_BITS))), "postings", POSTINGS, "token")  # texts are a quarter of their postings
        posted = self._own(folder, "postings", POSTINGS)
        counted = stored(indexed.token_counts(posted), "token-counts")
        put(indexed.peaks(posted, counted), "peaks", PEAKS, "token", ["block"])
        put(indexed.stems(counted), "stems", STEMS, "stem", ["token"])
        put(vocabulary(docs).select("word", F.col("first_doc").cast("long").alias("first_doc"), "first_pos"), "vocabulary", VOCABULARY)
        per = chunks.groupBy("commit", "source_id", "label").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum((F.col("content_type") == "code").cast("long")).alias("code_chunk_count"))
        put(per.withColumn("indexed_at", F.current_timestamp() if at is None else at), "sources", SOURCES)
        n = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("dl", "n_tokens"), ("gl", "n_grams")))).first().asDict()
        n["n_sources"] = self._own(folder, "sources", SOURCES).count()
        self._publish(folder, "commit", commit, n)
        return commit

    def with_grams(self) -> Snapshot:
        """A snapshot in which every commit has trigram postings; those that lack them are filled first."""
        snapshot = self.snapshot()
        for entry in snapshot.unfilled:
            folder = f"fill={uuid.uuid4().hex}"
            rows = indexed.gram_postings(self._own(entry["folder"], "chunks", CHUNKS))
            self._put(folder, rows, "grams", GRAMS, "gram", ["block"], entry["n_chunks"])
            self._publish(folder, "grams", entry["commit"], {})
        if not snapshot.unfilled:
            return snapshot
        known = {e["commit"] for e in snapshot.entries}
        now = self.snapshot()
        return Snapshot(self, [e for e in now.entries + now.filled if e["commit"] in known])

    @property
    def sources(self) -> DataFrame:
        return self.snapshot().sources

    @property
    def chunks(self) -> DataFrame:
        return self.snapshot().chunks

    @property
    def vocabulary(self) -> DataFrame:
        return self.snapshot().vocabulary

    def list_sources(self) -> DataFrame:
        """All sources, latest first."""
        return self.snapshot().sources.orderBy(F.desc("indexed_at"), "source_id")

    def stats(self) -> DataFrame:
        """One row: n_sources, n_chunks, n_words. The first two are totals of the log."""
        now = self.snapshot()
        return now.vocabulary.agg(F.lit(now.n_sources).cast("long").alias("n_sources"), F.lit(now.n_chunks).cast("long").alias("n_chunks"), F.count(F.lit(1)).alias("n_words"))

    def _put(self, folder: str, rows: DataFrame, name: str, schema: str, key: str | None = None, spread: list[str] | None = None, size: int = 0) -> None:
        """Write one table of a commit; with a ``key``, in buckets. With ``spread``, buckets are sorted and shared by several tasks, the more
        the larger ``size`` is in chunks; without it, rows are written where they are, by each task to all buckets."""
        path, columns = f"{self.path}/{name}/{folder}", [c for c in (x.split()[0] for x in schema.split(", ")) if not folder.startswith(f"{c}=")]
        if key is None:
            rows.select(columns).write.parquet(path)
            return
        rows = rows.withColumn("bucket", indexed.bucket(F.col(key), self.buckets))
        if spread is None:
            rows.select(columns).sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(path)
            return
        parts = max(self.parts, size // CHUNKS_IN_PART)
        tasks = min(self.buckets * parts, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), size // CHUNKS_IN_TASK))
        place = F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")
        dealt = rows.repartitionById(tasks, (F.col("bucket") * parts + place) % tasks)
        dealt.select(columns).sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)

    def _own(self, folder: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/{folder}")

    def _publish(self, folder: str, kind: str, commit: int, totals: dict) -> None:
        entry = {"folder": folder, "kind": kind, "commit": commit, "at": time.time_ns()} | totals
        publish(self.spark, f"{self.path}/log", f"{uuid.uuid4().hex}.json", json.dumps(entry))

