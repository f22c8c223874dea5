"""Ranked lexical search by Block-Max WAND over an inverted index in shards of documents.

Index: documents are dealt into shards of at most ``SHARD_DOCS`` documents and about ``SHARD_BYTES`` of text, as they are read, without a shuffle.
A shard has one row for each of its terms, with the term's postings (document, tf) in blocks of ``BLOCK`` each: gaps and tf as
bytes of seven bits. Beside the blocks stand their first and last documents and the greatest impact of any posting in them (an impact is
what a posting adds to a score before the term's weight). A common term is thus spread over all shards and no row is large.

Search: a shard's rows of the terms asked for meet in one task, whose items keep their best k and the least score that can still
enter from shard to shard. The borders of the blocks of an item's terms part the shard's documents into windows in which the same
blocks stand under all cursors. The sum of their greatest impacts, by weight, bounds every score in the window; cursors move on over the
windows that stay below the least score, by block borders alone (shallow moves), to the next one that does not, the pivot. Only blocks
that reach into such windows are decompressed, once for all items; a term with a single block has its cursor on its postings then. Scores of up to ``SPAN`` documents from the pivot on are
then summed exactly, and cursors move on from there with the new least score. No document that could enter is passed over: bounds are
not below scores, and ties go on to be ordered by doc_id.

Scores are integers: weight * (1000000000 * tf div (1000 * tf + 20 * m)) summed over an item's distinct terms, with
weight = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 50 + (50 * n * N div L).

Items may be many: they are asked in groups of about ``ITEMS``, each of which meets every shard on its own.

Defined cases: null and empty texts hold no terms, so they are never found and don't count in N; items without terms have no
results. Each row of documents and each row of items stands for itself, repeated ids too; a null doc_id comes before others among
equal scores. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import _remove_at_exit, scratch_path, small_batches, stored, tidy

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_DOCS, SHARD_BYTES, BLOCK, SPAN, ITEMS, SALTS = 2048, 8_000_000, 128, 1024, 1000, 64
INDEX = "shard long, term string, df int, blocks binary, payload binary"
NO_ID = np.iinfo(np.int64).min
#: Bytes in lower case, with all that is in no term as a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Index:
    """A written index, and its number of documents with a term and of terms in all."""

    path: str
    n_docs: int
    n_terms: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX).parquet(self.path)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the last with its top bit clear: the bytes, and where each value begins."""
    size = 1 + sum((values >= 1 << 7 * j).astype(np.int64) for j in range(1, 5))
    at = np.append(0, np.cumsum(size))
    out = np.zeros(at[-1], np.uint8)
    for j in range(5):
        more = np.flatnonzero(size > j)
        out[at[more] + j] = (values[more] >> 7 * j & 127) | np.where(size[more] > j + 1, 128, 0)
    return out, at


def unpacked(body: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(body < 128)
    if len(ends) == len(body):
        return body.astype(np.int64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(body)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((body & 127).astype(np.int64) << 7 * place, starts)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def shard_rows(shard: int, ids: list[int | None], texts: list[str], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A shard: one row with its documents (ids, then m), and one for each term in order, as in ``INDEX``."""
    bodies = [t.encode() for t in texts]
    body = np.frombuffer(b" ".join([*bodies, b" "]).translate(FOLD), np.uint8)
    inside = body != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edge[0::2], edge[1::2] - edge[0::2]
    doc = np.searchsorted(np.cumsum([len(b) + 1 for b in bodies]), starts, "right")
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32).tobytes()), pa.py_buffer(body[inside].tobytes())).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    count = len(ids)
    m = 50 + 50 * np.bincount(doc, minlength=count).astype(np.int64) * n_docs // max(n_terms, 1)
    key, tf = np.unique(rank[words.indices.to_numpy()] * count + doc, return_counts=True)
    term, doc = key // count, key % count
    term_at = np.searchsorted(term, np.arange(len(order) + 1))
    place = np.arange(len(term)) - np.repeat(term_at[:-1], np.diff(term_at))
    first = np.flatnonzero(place % BLOCK == 0)
    last = np.append(first, len(term))[1:] - 1
    values = np.stack([np.diff(doc, prepend=0), tf], axis=1).reshape(-1)
    body, at = packed(np.delete(values, 2 * first))
    begin = at[2 * first - np.arange(len(first))]  # of each block, whose first posting has no gap
    block_term = np.searchsorted(first, term_at)
    term_byte = np.append(begin, len(body))[block_term]
    top = np.maximum.reduceat(impact(tf, m[doc]), first) if len(first) else first
    blocks = np.stack([doc[first], doc[last], top, begin - np.repeat(term_byte[:-1], np.diff(block_term))], axis=1).astype("<i4")
    documents = np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes() + m.astype("<i8").tobytes()

    def binary(lead: bytes, offsets: np.ndarray, data: bytes) -> pa.Array:
        ends = np.append(0, np.append(0, offsets[1:]) + len(lead)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(lead + data)])

    terms = pa.concat_arrays([pa.array([None], pa.string()), words.dictionary.take(pa.array(order))])
    columns = [pa.array(np.full(len(terms), shard), pa.int64()), terms, pa.array(np.append(0, np.diff(term_at)), pa.int32()), binary(b"", block_term * 16, blocks.tobytes()), binary(documents, term_byte, body.tobytes())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def write_index(docs: DataFrame, path: str | None = None) -> Index:
    """Index every row of ``docs`` (doc_id, text) in ``path``, a new folder of the shared one where none is given."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(t.encode().translate(FOLD).split()) for batch in batches for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"docs": pa.array([sum(n > 0 for n in sizes)], pa.int64()), "terms": pa.array([sum(sizes)], pa.int64())})

    n_docs, n_terms = rows.select("text").mapInArrow(tidy(counted), "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, one in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids and (len(ids) == SHARD_DOCS or size + len(one) > SHARD_BYTES):
                    yield shard_rows(shard, ids, texts, n_docs, n_terms)
                    shard, ids, texts, size = shard + 1, [], [], 0
                ids.append(doc_id)
                texts.append(one)
                size += len(one)
        if ids:
            yield shard_rows(shard, ids, texts, n_docs, n_terms)

    if path is None:
        path = scratch_path(spark, "search-index")
        _remove_at_exit(spark, path)
    rows.mapInArrow(tidy(run), INDEX).write.parquet(path)
    return Index(path, n_docs, n_terms)


class Best:
    """The k best of an item so far, and the least score with which a document can enter."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.ids, self.scores = np.append(self.ids, ids), np.append(self.scores, scores)
        if len(self.ids) >= self.k:
            order = np.lexsort((self.ids, -self.scores))[: self.k]
            self.ids, self.scores = self.ids[order], self.scores[order]
            self.least = int(self.scores[-1])


class Shard:
    """The rows of one shard that some item asks for; blocks are decompressed when first needed."""

    def __init__(self, documents: bytes):
        both = np.frombuffer(documents, "<i8")
        self.ids, self.m = both[: len(both) // 2], both[len(both) // 2 :]
        self.terms, self.known, self.total = [], {}, 0

    def add(self, weight: int, blocks: bytes, payload: bytes) -> range:
        """Where the term's blocks stand in the shard."""
        table = np.frombuffer(blocks, "<i4").reshape(-1, 4)
        self.terms.append((weight, table, payload))
        self.total += len(table)
        return range(self.total - len(table), self.total)

    def close(self) -> None:
        tables = [t for _, t, _ in self.terms]
        whole = np.concatenate([*tables, np.zeros((0, 4), np.int32)]).astype(np.int64)
        self.first, self.end = whole[:, 0], whole[:, 1] + 1
        self.owner = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
        self.begin = np.append(0, np.cumsum([len(t) for t in tables]))
        self.bound = whole[:, 2] * np.array([w for w, _, _ in self.terms], np.int64)[self.owner] if self.total else whole[:, 2]

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a block and what each adds to a score."""
        found = self.known.get(i)
        if found is None:
            weight, table, payload = self.terms[self.owner[i]]
            j = i - self.begin[self.owner[i]]
            values = unpacked(np.frombuffer(payload[table[j, 3] : table[j + 1, 3] if j + 1 < len(table) else None], np.uint8))
            docs = np.cumsum(np.append(table[j, 0], values[1::2]))
            found = self.known[i] = docs, weight * impact(values[0::2], self.m[docs])
        return found


def windows(first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The borders of the ranges and, from each border to the next, the sum of the bounds of the ranges that are there."""
    borders = np.unique(np.concatenate([first, end]))
    change = np.zeros(len(borders), np.int64)
    np.add.at(change, np.searchsorted(borders, first), bound)
    np.subtract.at(change, np.searchsorted(borders, end), bound)
    return borders, np.cumsum(change)


def any_in(first: np.ndarray, end: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether any flag is set from ``first`` up to ``end``."""
    before = np.append(0, np.cumsum(flags))
    first, end = np.clip(first, 0, len(flags)), np.clip(end, 0, len(flags))
    return before[end] > before[first]


def search_shard(shard: Shard, own: list[range], best: Best) -> None:
    """Add to ``best`` what it takes from a shard; ``own`` are the blocks of the item's terms."""
    at = np.concatenate([np.arange(r.start, r.stop) for r in own])
    first, end = shard.first[at], shard.end[at]
    borders, upper = windows(first, end, shard.bound[at])
    likely = any_in(np.searchsorted(borders, first), np.searchsorted(borders, end), upper >= best.least)
    if not likely.any():
        return
    # The cursors of terms with a single block stand on their postings: those are few, and far apart under one bound.
    single = np.repeat([len(r) == 1 for r in own], [len(r) for r in own])
    known = [shard.block(i) for i in at[single & likely].tolist()]
    docs, parts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*known, strict=True) if known else ((), ())))
    borders, upper = windows(np.append(first[~single], docs), np.append(end[~single], docs + 1), np.append(shard.bound[at[~single]], parts))
    since, until, here = np.searchsorted(borders, first), np.searchsorted(borders, end), 0
    while len(ahead := np.flatnonzero(upper[here:] >= best.least)):
        here += int(ahead[0])  # the pivot
        stop = min(max(here + 1, int(np.searchsorted(borders, borders[here] + SPAN))), len(borders) - 1)
        reach = any_in(since - here, until - here, upper[here:stop] >= best.least)
        low, high = int(borders[here]), int(borders[stop])
        scores = np.zeros(high - low, np.int64)
        for i in at[reach].tolist():
            docs, part = shard.block(i)
            if docs[0] < low or docs[-1] >= high:
                a, b = np.searchsorted(docs, (low, high))
                docs, part = docs[a:b], part[a:b]
            scores[docs - low] += part
        hits = np.flatnonzero(scores >= best.least)  # in other windows, sums stay below
        if len(hits):
            best.add(shard.ids[low + hits], scores[hits])
        here = stop


def best_of_shards(met: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score: the k best of each item in each task. ``met`` has ``INDEX`` with part, weight, qids, and comes in order of part, shard and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, own, found = None, None, {}, {}

        def finish() -> None:
            if shard is not None and own:
                shard.close()
                for qid, blocks in own.items():
                    search_shard(shard, blocks, found.setdefault(qid, Best(k)))

        def emptied() -> Iterator[pa.RecordBatch]:
            for qid, best in found.items():
                ids = pa.array(best.ids, pa.int64(), mask=best.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid), pa.int64()), ids, pa.array(best.scores, pa.int64())], ["qid", "doc_id", "score"])
            found.clear()

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("part", "shard", "term", "weight", "qids", "blocks", "payload")}
            for part, number, term, weight, qids, blocks, payload in zip(*columns.values(), strict=True):
                if (part, number) != at:
                    finish()
                    if at is not None and part != at[0]:
                        yield from emptied()
                    at, shard, own = (part, number), None, {}
                if term is None:
                    shard = Shard(payload)
                elif shard is not None:
                    mine = shard.add(weight, blocks, payload)
                    for qid in qids:
                        own.setdefault(qid, []).append(mine)
        finish()
        yield from emptied()

    return met.mapInArrow(tidy(run), "qid long, doc_id long, score long")


def asked_terms(items: DataFrame, rows: DataFrame, n_docs: int, groups: int) -> DataFrame:
    """part, term, weight, qids: for each group of items its terms that some document has, without those of weight 0."""
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), 0))
    asked = items.select("qid", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("part"), F.explode(words).alias("term"))
    df = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("n") + 1))).cast("long")
    return asked.groupBy("part", "term").agg(F.collect_list("qid").alias("qids")).join(df.select("term", weight.alias("weight")), "term").filter("weight > 0")


def best_first(df: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of ``items`` (item_id, text), best first, ties by doc_id."""
    small_batches(items.sparkSession)
    rows = index.rows(items.sparkSession)
    named = stored(items.select("item_id", "text").withColumn("qid", F.monotonically_increasing_id()), "search-items")
    groups = max(1, -(-named.count() // ITEMS))
    terms = stored(asked_terms(named, rows, index.n_docs, groups), "search-terms")
    parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))
    documents = rows.filter("term IS NULL").select("*", parts.alias("part"), F.lit(None).cast("array<long>").alias("qids"), F.lit(None).cast("long").alias("weight"))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # postings are few bytes but much work
    met = rows.join(terms, "term").unionByName(documents).repartition(tasks, "part", "shard").sortWithinPartitions("part", "shard", F.asc_nulls_first("term"))
    found = best_of_shards(met, k).withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    best = best_first(best_first(found, k, "qid", "salt"), k, "qid")
    return best.join(named.select("qid", "item_id"), "qid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` over an index written for the occasion."""
    return search(write_index(docs), items, k)
