"""Token-ID output: documents tokenised into grammar-compressed shards that can be read at random.

A shard holds whole documents, in ascending doc_id order (null first, equal ids by text), of about ``SHARD_IDS`` ids.
Its ids are compressed by Re-Pair: pairs of neighbouring symbols that occur often become nonterminals, until no pair
occurs ``MIN_COUNT`` times or the 16-bit symbols are used up. Counts are taken anew in rounds, not after each single
replacement: a round takes all frequent pairs by descending count, and where two overlap the more frequent one wins. A pair of old symbols
only loses places, so a round after the first counts pairs with a new symbol, and those the last round left frequent. Pairs
never hold the end id, so no nonterminal crosses a document.

File format: Parquet, one row for each shard (part, seq, n_docs, n_ids, body). ``body`` is little-endian: magic
``LRP1``; uint32 n_terminals, n_rules, n_symbols, n_docs; then rules (2 x uint16 each), expansion lengths of the
rules (uint32), the symbols (uint16), ids of each document with its end id (uint32), doc_ids (int64), and one byte
for each document that is 1 where its doc_id is null. Parts are ranges of doc_id; (part, seq) is corpus order.
The expansion lengths let ``read_ids`` find and expand only the symbols it needs.

Defined cases: a null or empty text is the end id alone; equal rows are all kept; an empty table gives no shard and
no rows; other columns are ignored. A tokenizer of 65,536 ids or more is an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import scratch_path, small_batches, tidy
from lodestone.llm._rolling import text_bytes

SHARD_IDS = 1 << 19
MIN_COUNT = 24
END_ID = 1
#: Symbols of 16 bits.
MOST_SYMBOLS = 1 << 16
MAGIC = b"LRP1"
#: Words that a worker remembers the ids of, at most.
REMEMBERED = 400_000


#: Kind of a byte: 0 white space, 1 letter (or part of one), 2 digit, 3 punctuation, 4 what needs the full tokenizer.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_KIND[48:58] = 2
_KIND[[*range(0, 32), 127, ord("'"), ord("<")]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 0


class WordTokenizer:
    """A tokenizer that splits at white space first, with the ids of words remembered.

    Words of plain Latin letters, with ASCII punctuation before or after, go to the bare BPE model in one call for a
    whole batch; for these the normaliser and pre-tokeniser only lower the case, part letters from punctuation and
    map bytes, which is done here. All others take the full tokenizer.
    """

    _plain = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.size = self.full.get_vocab_size()
        if self.size >= MOST_SYMBOLS:
            raise ValueError(f"{self.size} ids do not fit 16-bit symbols")
        ends = np.zeros(self.size + 1, bool)
        for token, i in self.full.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.index, self.flat, self.starts, self.counts = {}, np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Bytes above ASCII as the byte-level alphabet writes them: 0xA1-0xAC and 0xAE-0xFF stand for themselves, the others follow from U+0100 on in order.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.bytes = [(chr(b), chr(256 + odd.index(b))) for b in range(0x80, 0xC0) if b in odd]
        self._forget()

    def _forget(self) -> None:
        """Keep the words met again, if they are less than half."""
        uses = getattr(self, "uses", np.zeros(0, np.int64))
        keep = np.flatnonzero(uses > 1)
        keep = keep if len(keep) < REMEMBERED // 2 else keep[:0]
        words = list(self.index) if len(keep) else []
        self.index: dict[str, int] = {words[i]: n for n, i in enumerate(keep.tolist())}
        counts = self.counts[keep] if len(keep) else np.zeros(0, np.int64)
        before = np.cumsum(counts) - counts
        self.flat = self.flat[np.repeat(self.starts[keep] - before, counts) + np.arange(counts.sum())] if len(keep) else np.zeros(0, np.uint16)
        self.starts, self.counts, self.uses = before, counts, np.zeros(len(keep), np.int64)

    def _learn(self, words: list[str]) -> None:
        plain, other, pieces, shown = [], [], [], []
        match = self._plain.fullmatch
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                plain.append(i)
                pieces.append(1)
                shown.append(w)
            elif (m := match(w)) and "<|" not in w:
                parts = [x for x in m.groups() if x]
                plain.append(i)
                pieces.append(len(parts))
                shown += parts
            else:
                other.append(i)
        ids = [np.zeros(0, np.int64)]
        counts = np.zeros(len(words), np.int64)
        if plain:
            text = " ".join(shown).lower()
            if not text.isascii():
                text = text.encode().decode("latin-1")
                for c, as_shown in self.bytes:
                    text = text.replace(c, as_shown)
            got = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.ends[got])[np.cumsum(pieces) - 1]
            counts[plain] = np.diff(np.concatenate(([-1], last)))
            ids.append(got)
        if other:
            for i, e in zip(other, self.full.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
                ids.append(np.array(e.ids, np.int64))
                counts[i] = len(ids[-1])
        order = np.array(plain + other, np.int64)
        starts = np.zeros(len(words), np.int64)
        starts[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        self.flat = np.concatenate((self.flat, np.concatenate(ids).astype(np.uint16)))
        self.starts, self.counts = np.concatenate((self.starts, starts)), np.concatenate((self.counts, counts))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), with the end id after each, and the number of ids of each text."""
        raw, offsets = text_bytes(texts)
        raw, starts, cuts = _segments(raw, offsets)
        lengths = np.ones(len(texts), np.int64)
        if not len(starts):
            return np.full(len(texts), END_ID, np.uint16), lengths
        if len(self.index) > REMEMBERED:
            self._forget()
        edges = np.append(starts, len(raw)).astype(np.int64)
        joined = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(raw)).dictionary_encode()
        words = joined.dictionary.to_pylist()
        index = self.index
        number = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(number < 0)):
            number[new] = len(index) + np.arange(len(new))
            fresh = [words[i] for i in new.tolist()]
            index.update(zip(fresh, number[new].tolist(), strict=True))
            self._learn(fresh)
        which = joined.indices.to_numpy()
        self.uses[number] += np.bincount(which, minlength=len(words))
        number = number[which]
        counts = self.counts[number]
        before = np.concatenate(([0], np.cumsum(counts)))
        bounds = before[cuts]
        ids = self.flat[np.repeat(self.starts[number] - before[:-1], counts) + np.arange(before[-1])]
        return np.insert(ids, bounds[1:], END_ID), lengths + np.diff(bounds)


def _segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without white space, where segments begin, and the first segment of each text.

    A text of ASCII and Latin-1 letters without apostrophes, angle brackets and control characters is put in lower
    case and cut where letters, digits and punctuation meet, as the pre-tokeniser would do; any other text only after white space.
    """
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[raw]
    odd = kind == 4
    high = raw >= 0x80
    if high.any():
        lead = raw == 0xC3
        after = np.concatenate(([False], lead[:-1]))
        odd |= high & ~lead & ~(after & (raw != 0x97) & (raw != 0xB7))
    else:
        after = None
    seen = np.concatenate(([0], np.cumsum(odd)))
    simple = np.repeat(seen[offsets[1:]] == seen[offsets[:-1]], np.diff(offsets))
    upper = (raw >= 65) & (raw <= 90)
    if after is not None:
        upper |= after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    raw = raw + ((upper & simple) * 32).astype(np.uint8)
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    begins = (before == 0) | (simple & (kind != before))
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    solid = kind != 0
    cuts = np.searchsorted(np.flatnonzero(begins & solid), offsets)
    return raw[solid], np.flatnonzero(begins[solid]), cuts


def _slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(2654435761)) >> np.uint32(12)


def compress(ids: np.ndarray, terminals: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one shard: rules (pairs), their expansion lengths, and the remaining symbols."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(terminals, np.int64)
    never = np.zeros(0, np.uint32)  # pairs of two equal symbols that are counted twice but can be replaced once
    fresh, still = 0, np.zeros(1 << 20, bool)  # the first new symbol, and slots of pairs that are still frequent
    while len(seq) > 1 and len(lengths) < MOST_SYMBOLS:
        left, right = seq[:-1], seq[1:]
        pair = (left << np.uint32(16)) | right
        open_ = (left != END_ID) & (right != END_ID)
        if fresh:
            open_ &= (left >= fresh) | (right >= fresh) | still[_slots(pair)]
        if len(never):
            open_ &= ~np.isin(pair, never)
        place = np.flatnonzero(open_)
        # Hashed counts never undercount, so the frequent pairs are among the places kept here.
        slot = _slots(pair[place])
        place = place[(np.bincount(slot, minlength=1 << 20) >= min_count)[slot]]
        found, back, times = np.unique(pair[place], return_inverse=True, return_counts=True)
        order = np.lexsort((found, -times))
        order = order[: min(MOST_SYMBOLS - len(lengths), int((times >= min_count).sum()))]
        if not len(order):
            break
        rank = np.full(len(found), len(order), np.int32)
        rank[order] = np.arange(len(order))
        # A place is replaced if no overlapping pair ranks before its own; of equal pairs in a row, every second one.
        ranks = np.full(len(pair) + 2, len(order), np.int32)
        ranks[place + 1] = rank[back]
        mid, before = ranks[1:-1], ranks[:-2]
        at = np.flatnonzero((mid < len(order)) & (mid <= before) & (mid <= ranks[2:]))
        tied = mid[at] == before[at]
        if tied.any():
            # In a run of one symbol, pairs at an even distance from the run's first stay.
            run = np.flatnonzero(~(tied & np.concatenate(([False], at[1:] == at[:-1] + 1))))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        done = np.bincount(mid[at], minlength=len(order))
        good = done >= max(2, min_count // 2)  # a pair of two equal symbols counts its overlaps as well
        if not good.any():  # the first in rank holds up the others
            never = np.append(never, found[order[:1]])
        at = at[good[mid[at]]]
        name = np.cumsum(good) - 1 + len(lengths)
        pairs = found[order[good]]
        still[:] = False
        still[_slots(found[order[times[order] - np.where(good, done, 0) >= min_count]])] = True
        fresh = len(lengths)
        rules.append(np.stack((pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)), axis=1).astype(np.uint16))
        lengths = np.concatenate((lengths, lengths[rules[-1][:, 0]] + lengths[rules[-1][:, 1]]))
        seq[at] = name[mid[at]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16), lengths[terminals:], seq.astype(np.uint16)


def pack(ids: np.ndarray, per_doc: np.ndarray, doc_ids: list[int | None], terminals: int, min_count: int = MIN_COUNT) -> bytes:
    """The body of a shard."""
    rules, lengths, seq = compress(ids, terminals, min_count)
    head = np.array([terminals, len(rules), len(seq), len(doc_ids)], "<u4")
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = (head.astype("<u4"), rules.astype("<u2"), lengths.astype("<u4"), seq.astype("<u2"), per_doc.astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), null)
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's body, opened for reading."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.terminals, n_rules, n_symbols, n_docs = (int(x) for x in np.frombuffer(body, "<u4", 4, 4))
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", 2 * n_rules).reshape(-1, 2)
        self.lengths = np.concatenate((np.ones(self.terminals, np.int64), take("<u4", n_rules)))
        self.symbols = take("<u2", n_symbols)
        self.per_doc = take("<u4", n_docs).astype(np.int64)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null, strict=True)]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while (high := symbols >= self.terminals).any():
            at = np.flatnonzero(high)
            left = self.rules[symbols[at] - self.terminals].astype(np.int64)
            out = np.insert(symbols, at + 1, left[:, 1])
            out[at + np.arange(len(at))] = left[:, 0]
            symbols = out
        return symbols.astype(np.uint32)

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return self._expand(self.symbols)

    def read_ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the shard's id ``start`` on; only symbols that reach into them are expanded."""
        ends = np.cumsum(self.lengths[self.symbols])
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, start + n, side="left"))
        begin = int(ends[first - 1]) if first else 0
        return self._expand(self.symbols[first : last + 1])[start - begin : start - begin + n]

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's document number ``i``."""
        return self.read_ids(int(self.per_doc[:i].sum()), int(self.per_doc[i]))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer. A function of the module, since what a stage's own code refers to is copied for each task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _merged(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_shards(docs: DataFrame, path: str, tokenizer: str, min_count: int = MIN_COUNT) -> None:
    """Tokenise ``docs`` (doc_id, text) and write the shards to ``path``; ``tokenizer`` is a file on every node."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = _tokenizer(tokenizer)
        seq, ids, per_doc, names, held = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            all_ids, counts = np.concatenate(ids), np.concatenate(per_doc)
            body = pack(all_ids, counts, names, coder.size, min_count)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(names)], "n_ids": [len(all_ids)], "body": [body]}, schema=kind)

        kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("body", pa.binary())])
        for batch in _merged(batches):
            got, counts = coder.encode(batch.column("text"))
            ids.append(got)
            per_doc.append(counts)
            names += batch.column("doc_id").to_pylist()
            held += len(got)
            if held >= SHARD_IDS:
                yield flush()
                seq, ids, per_doc, names, held = seq + 1, [], [], [], 0
        if names:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(run), "part int, seq int, n_docs long, n_ids long, body binary").write.mode("overwrite").parquet(path)


def _described(bodies: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, seq, body in bodies:
        shard = Shard(body)
        raw = memoryview(shard.ids().astype("<u4").tobytes())
        ends = np.cumsum(shard.per_doc)
        starts = ends - shard.per_doc
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = len(crcs)
        columns = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.per_doc), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: doc_id, start, n_tokens, ids_crc32; all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _described(zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "body")), strict=True))

    shards = spark.read.parquet(path)
    # Prefix sums in two steps: over the parts (as many as write tasks), and over the shards of each part.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before_part", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inside = Window.partitionBy("part").orderBy("seq")
    first = shards.select("part", "seq", "n_ids").withColumn("before", F.sum("n_ids").over(inside) - F.col("n_ids")).join(parts.select("part", "before_part"), "part")
    found = shards.select("part", "seq", "body").mapInArrow(tidy(run), "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    start = F.col("before_part") + F.col("before") + F.col("inner")
    return found.join(first, ["part", "seq"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """Write the shards, to the shared folder unless ``path`` is given, and describe the documents read back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_shards(docs, path, tokenizer, min_count)
    return read_documents(docs.sparkSession, path)
