"""Token counts of whole texts by a byte-level BPE tokenizer; huge documents by overlap resynchronisation.

A document of more than ``chunk`` characters is cut into chunks that overlap by ``overlap`` characters. Each chunk is
encoded on its own, with offsets, wherever a task is free. Two neighbours are spliced at a boundary that both have:

* The tokenizer splits a text into pieces from left to right and never looks back, so where a piece of the whole text
  begins, the tokens from there on follow from the text from there on. A place at which a piece of the left chunk ends is
  such a beginning, if the left chunk's end is too far off to have changed it (``margin``: a special string or a
  contraction that the end cuts). By induction the left chunk is right up to its splice with the chunk after it.
* So if a piece of the right chunk begins there too, its tokens from there on are the document's.

A boundary of tokens inside a piece proves nothing and is not used. Where the overlap holds no common boundary (a word
longer than it), that document's chunks and overlaps are made four times as large, and so on until all align or
the document is one chunk.

Shorter texts are cut where a white space follows anything else, which always begins a piece; what is between is
encoded once for each worker and remembered (``REMEMBERED`` strings of up to ``LONGEST`` characters).

Defined cases: null texts count as empty, with 0 tokens. Special strings in a text become special tokens, as is the
library's default. Repeated rows and null ids each keep their row. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import small_batches, stored, tidy

CHUNK, OVERLAP, WIDER = 32_768, 512, 4
REMEMBERED, LONGEST = 400_000, 64
#: The longest contraction that is a piece of its own.
CONTRACTION = 3
#: White space by any definition, beyond the ASCII white space by which texts are cut.
ODD_SPACE = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff"
UNIT = re.compile(rf"[ \t-\r]*(?:[^ \t-\r{ODD_SPACE}]+|[{ODD_SPACE}][ \t-\r]*)+|[ \t-\r]+")
CHUNKS = "uid long, doc_id long, n_bytes long, chars long, k long, size long, text string"
PIECES = "uid long, doc_id long, n_bytes long, k long, n long, head array<int>, head_at array<int>, tail array<int>, tail_at array<int>"


@functools.lru_cache(maxsize=4)
def loaded(path: str):
    """The tokenizer of a file, and how close to a chunk's end a boundary is not proven."""
    from tokenizers import Tokenizer

    rules = json.loads(Path(path).read_text())
    before, special = rules.get("pre_tokenizer") or {}, rules.get("added_tokens") or []
    greedy = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in special)
    if rules.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or rules.get("post_processor") or greedy:
        raise ValueError("boundaries are proven only for byte-level tokenizers that split texts by the usual pattern and change nothing before")
    return Tokenizer.from_file(path), max([CONTRACTION, *(len(x["content"]) for x in special)])


def boundaries(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin or end, in characters, and how many tokens are before; the last is the end of the text."""
    found = loaded(path)[0].encode(text, add_special_tokens=False)
    piece, ends = np.array(found.word_ids), np.array([e for _, e in found.offsets], dtype=np.int64)
    last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if len(piece) else np.zeros(0, np.int64)
    return np.append(0, ends[last]), np.append(0, last + 1)


class Counter:
    """Token counts of texts; what stands between cuts is encoded once and remembered."""

    def __init__(self, path: str):
        self.tokenizer, self.known = loaded(path)[0], {}

    def count(self, texts: list[str]) -> list[int]:
        units = [UNIT.findall(t) for t in texts]
        new = list({u for us in units for u in us}.difference(self.known))
        more = {u: len(x.ids) for u, x in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)} if new else {}
        if len(self.known) + len(more) > REMEMBERED:
            self.known = {u: self.known[u] for us in units for u in us if u in self.known}
        self.known.update(more)
        out = [sum(map(self.known.__getitem__, us)) for us in units]
        for u in more:
            if len(u) > LONGEST or len(self.known) > REMEMBERED:
                del self.known[u]
        return out


def short_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of (doc_id, n_bytes, text), one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            n = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long")


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk ``k`` of each document of (uid, doc_id, n_bytes, text): ``size`` characters and the overlap after them."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, n_bytes, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "n_bytes", "text")), strict=True):
                rows = [(uid, doc_id, n_bytes, len(text), at // chunk, min(chunk, len(text) - at), text[at : at + chunk + overlap]) for at in range(0, len(text), chunk)]
                for i in range(0, len(rows), 64):
                    columns = [pa.array(c, pa.string() if name == "text" else pa.int64()) for name, c in zip(names, zip(*rows[i : i + 64], strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, CHUNKS)


def encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Tokens of each chunk, its boundaries in the overlap before it (``head``) and after it (``tail``), counted from where the right one of two neighbours begins."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = loaded(path)[1]
        for batch in batches:
            rows = []
            for uid, doc_id, n_bytes, chars, k, size, text in zip(*(batch.column(c.split()[0]).to_pylist() for c in CHUNKS.split(", ")), strict=True):
                at, tokens = boundaries(path, text)
                first = at <= overlap
                sure = len(text) if k * chunk + len(text) == chars else len(text) - margin
                last = (at >= size) & (at <= sure)
                rows.append((uid, doc_id, n_bytes, k, int(tokens[-1]), at[first], tokens[first], at[last] - size, tokens[last]))
            columns = [pa.array(c, pa.int64() if i < 5 else pa.list_(pa.int32())) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.mapInArrow(tidy(run), PIECES)


def spliced(pieces: DataFrame) -> DataFrame:
    """uid, doc_id, n_bytes, n_tokens and how many neighbours did not align, from each document's encoded chunks.

    A pair adds the left chunk's tokens up to their first common boundary and takes off the right one's up to there.
    """
    right = pieces.select("uid", (F.col("k") - 1).alias("k"), F.col("head").alias("r"), F.col("head_at").alias("r_at"))
    met = pieces.join(right, ["uid", "k"], "left").withColumn("p", F.array_min(F.array_intersect("tail", "r")))
    place = lambda ends, at: F.get(at, F.array_position(ends, F.col("p")).cast("int") - 1)
    part = F.when(F.col("r").isNull(), F.col("n")).otherwise(place("tail", "tail_at") - place("r", "r_at"))
    return met.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(part).alias("n_tokens"), F.count_if(F.col("r").isNotNull() & F.col("p").isNull()).alias("apart"))


def widened(chunks: DataFrame, uids: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The chunks of some documents put together by ``WIDER``, with overlaps as many times as long."""
    own = ["uid", "doc_id", "n_bytes", "chars"]
    body, group, place = F.left("text", F.col("size").cast("int")), F.floor(F.col("k") / WIDER).cast("long"), F.col("k") % WIDER
    here = F.struct(group.alias("k"), place.alias("place"), F.col("size").alias("size"), body.alias("text"))
    over = F.struct((group - 1).alias("k"), F.lit(WIDER).cast("long").alias("place"), F.lit(0).cast("long").alias("size"), F.left(body, F.lit(WIDER * overlap)).alias("text"))
    parts = F.when((place == 0) & (group > 0), F.array(here, over)).otherwise(F.array(here))
    each = chunks.join(uids, "uid", "left_semi").select(*own, F.explode(parts).alias("x")).select(*own, "x.*")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    return each.groupBy("uid", "k").agg(*(F.max(c).alias(c) for c in own[1:]), F.sum("size").alias("size"), whole.alias("text")).select(*(c.split()[0] for c in CHUNKS.split(", ")))


def long_counts(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of (doc_id, n_bytes, text) by overlapping chunks."""
    chunks, found = stored(cut(docs.withColumn("uid", F.monotonically_increasing_id()), chunk, overlap), "token-chunks"), []
    while True:  # a round for each time that overlaps are widened, until chunks are as long as the longest text
        dealt = chunks.repartition("uid", "k")
        counts = stored(spliced(stored(encoded(dealt, path, chunk, overlap), "token-pieces")), "token-counts")
        found.append(counts.filter("apart = 0").select("doc_id", "n_bytes", "n_tokens"))
        again = counts.filter("apart > 0").select("uid")
        if again.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        chunks = stored(widened(chunks, again, chunk, overlap), "token-chunks")
        chunk, overlap = WIDER * chunk, WIDER * overlap


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``; ``tokenizer`` is a file that is at the same path on every node."""
    if not 0 < overlap * WIDER <= chunk:
        raise ValueError(f"an overlap is positive and at most a {WIDER}th of a chunk")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    huge = F.char_length("text") > chunk
    both = short_counts(rows.filter(~huge), tokenizer).unionByName(long_counts(rows.filter(huge), tokenizer, chunk, overlap))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
