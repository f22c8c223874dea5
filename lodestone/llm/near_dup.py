"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on full shingle sets.

1. Equal word sequences, told by a 128-bit BLAKE2 digest, become one node. A node has a signature of b-bit minima (b = 16), cut into chunks of
   ``CHUNK`` values. By the pigeonhole principle, two signatures that differ in at most 2 * chunks - 1 places have a
   chunk with at most one difference. So each chunk is indexed once for every place left out (the enumerated
   error): all pairs within that distance share a key. The number of chunks is such that a pair just at the
   threshold has a chance of 1e-7 at most to share none.
2. Nodes that share a key are linked for now: in small key groups each pair whose 64-bit sketches differ in no
   more bits than signatures within the distance can, in
   crowded ones (many copies of one text) each node to the group's least. Components of these links are clusters.
3. Clusters get their texts, once per node, and every pair is compared exactly there. A cluster with more than
   ``BLOCK`` shingles is cut into blocks by hash, one task for each two blocks; only a spanning forest comes out.
4. Components of the confirmed links are the groups of near-duplicates.

Words are runs of non-white-space with A-Z in lower case. Shingles are hashed to 64 bits for the comparison.

Defined cases: null, empty and word-less texts have no shingles and are linked with nothing, not even each other.
Texts with fewer words than a shingle have one, the whole sequence. component_id is the least non-null doc_id of the
component (null if there is none); rows with a null or repeated doc_id keep their result rows. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import identified, small_batches, spread_join, stored, tidy
from lodestone.llm._rolling import U, joined_words, mix, row_words, text_bytes, word_grams, word_symbols
from lodestone.llm.components import connected

CHUNK = 6
#: Key groups up to this size give pairs, larger ones stars.
CROWD = 16
#: Shingles in one block of a cluster.
BLOCK = 150_000


def chunks_for(percent: int) -> int:
    """Chunks needed for a chance of a miss under 1e-7 at the threshold."""
    j = percent / 100
    one = j**CHUNK + CHUNK * (1 - j) * j ** (CHUNK - 1)
    return max(11, math.ceil(math.log(1e-7) / math.log(max(1e-12, 1 - one)))) if one < 1 else 11


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text, its distinct shingle hashes (sorted) and the digest of its word sequence."""
    raw, offsets = text_bytes(column)
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper * 32).astype(np.uint8)
    starts, ends, cuts = row_words(raw, offsets)
    grams = word_grams(word_symbols(raw, starts, ends), shingle)
    words, starts, ends = joined_words(raw, starts, ends)
    data = memoryview(words.tobytes())
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        whole = hashlib.blake2b(data[starts[a] : ends[b - 1]] if b > a else b"", digest_size=16).digest()
        if b - a >= shingle:
            yield np.unique(grams[a : b - shingle + 1]), whole
        else:
            yield np.frombuffer(whole[:8] if b > a else b"", np.uint64), whole


def _signer(places: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(77))
    return r.integers(0, 2**63, places, dtype=np.uint64) * U(2) + U(1), r.integers(0, 2**63, places, dtype=np.uint64)


def signature(grams: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """16-bit images of the minima under each of the permutations."""
    least = np.full(len(factors), ~U(0), np.uint64)
    for a in range(0, len(grams), 2048):
        part = (grams[a : a + 2048, None] ^ terms) * factors
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) >> U(48)).astype(np.uint16)


SIGNED = "rid long, rth long, doc_id long, v binary, n_shingles long, sig binary"


def _sign(shingle: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, terms = _signer(places)
        for batch in batches:
            sizes, nodes, sigs = [], [], []
            for grams, whole in shingle_sets(batch.column("text"), shingle):
                sizes.append(len(grams))
                nodes.append(whole)
                sigs.append(signature(grams, factors, terms).tobytes() if len(grams) else None)
            columns = [batch.column(c) for c in ("rid", "rth", "doc_id")]
            columns += [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "rth", "doc_id", "v", "n_shingles", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's keys: for every chunk and place left out, a hash of the other places; and the node's sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(np.uint64)
        bits = (sig[:, :64] & U(1)) << np.arange(64, dtype=np.uint64)
        sketch = np.bitwise_or.reduce(bits, axis=1)
        chunks = sig.reshape(len(sig), -1, CHUNK)
        salt = mix(np.arange(1, chunks.shape[1] * CHUNK + 1, dtype=np.uint64)).reshape(-1, CHUNK)
        terms = mix(chunks * U(0x9E3779B97F4A7C15) + salt)
        keys = mix((terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms) ^ salt).reshape(len(sig), -1)
        n = keys.shape[1]
        names = np.repeat(np.frombuffer(b"".join(batch.column("v").to_pylist()), "V16"), n)
        nodes = pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)), pa.py_buffer(names.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), nodes, pa.array(np.repeat(sketch, n).view(np.int64))], ["key", "v", "sketch"])


def _candidates(nodes: DataFrame, percent: int = 80) -> DataFrame:
    """Links (a, b) to be confirmed, of nodes that share a key."""
    # A sketch has one bit of a place, so it differs in as many bits as the signature does in places, at most.
    distance = 2 * chunks_for(percent) - 1
    keys = nodes.mapInArrow(tidy(_keys), "key long, v binary, sketch long")
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("hub")).filter("n > 1"), "keys")
    members = stored(spread_join(keys, shared, ["key"], "n"), "members")
    crowded = members.filter(f"n > {CROWD}").select(F.col("v").alias("a"), F.col("hub").alias("b"))
    few = members.filter(f"n <= {CROWD}").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("v", "sketch"))).alias("m"))
    pairs = few.select(
        F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["v"] > x["v"]) & (F.bit_count(y["sketch"].bitwiseXOR(x["sketch"])) <= distance)), lambda y: F.struct(y["v"].alias("a"), x["v"].alias("b")))))).alias("p")
    )
    return pairs.select("p.a", "p.b").unionByName(crowded).distinct()


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of the two lists are similar enough (right None: within the left list)."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = df[word] > 1
    owner, word = owner[common], word[common]
    used, word = np.unique(word, return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(left)
    both = np.zeros((n, len(sets) - n if right else n), np.float32)
    for a in range(0, len(used), 4096):
        inside = (word >= a) & (word < a + 4096)
        flags = np.zeros((len(sets), min(4096, len(used) - a)), np.float32)
        flags[owner[inside], word[inside] - a] = 1
        both += flags[:n] @ (flags[n:] if right else flags).T
    both = np.rint(both).astype(np.int64)
    union = sizes[:n, None] + (sizes[n:] if right else sizes)[None, :] - both
    return 100 * both >= percent * union


def _forest(linked: np.ndarray, rows: list[int], columns: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links (matrix of rows against columns; the same list for links within a block)."""
    names = list(dict.fromkeys([*rows, *columns]))
    at = {v: i for i, v in enumerate(names)}
    across = np.array([at[v] for v in columns])
    seen_row, seen = np.zeros(len(rows), bool), np.zeros(len(names), bool)
    out = []
    for start in range(len(rows)):
        if seen_row[start]:
            continue
        stack = [start]
        seen_row[start] = seen[at[rows[start]]] = True
        while stack:
            r = stack.pop()
            new = np.flatnonzero(linked[r] & ~seen[across])
            for c in new.tolist():
                seen[across[c]] = True
                out.append((rows[r], columns[c]))
            if rows is columns:
                seen_row[new] = True
                stack += new.tolist()
            elif len(new):
                more = np.flatnonzero(linked[:, new].any(axis=1) & ~seen_row)
                for q in more.tolist():
                    seen_row[q] = seen[at[rows[q]]] = True
                    out.append((rows[q], columns[new[np.argmax(linked[q, new])]]))
                stack += more.tolist()
    return out


def _confirm(shingle: int, percent: int):
    """Exact comparison of the nodes of each task; rows come sorted by task."""

    def answer(held: list[tuple[int, int, np.ndarray]], one: bool) -> list[tuple[int, int]]:
        first = min(b for _, b, _ in held)
        left = [(v, g) for v, b, g in held if b == first]
        names, sets = [v for v, _ in left], [g for _, g in left]
        if one:
            return _forest(_links(sets, None, percent), names, names) if len(left) > 1 else []
        right = [(v, g) for v, b, g in held if b != first]
        if not right:
            return []
        return _forest(_links(sets, [g for _, g in right], percent), names, [v for v, _ in right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        task, one = None, True
        for batch in batches:
            out: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi", "v", "block")), shingle_sets(batch.column("text"), shingle), strict=True)
            for root, lo, hi, v, block, (grams, _) in rows:
                if (root, lo, hi) != task:
                    if held:
                        out += answer(held, one)
                    task, one, held = (root, lo, hi), lo == hi, []
                held.append((v, block, grams))
            if out:
                yield _edges(out)
        if held and (out := answer(held, one)):
            yield _edges(out)

    return run


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.binary()), pa.array([e[1] for e in out], pa.binary())], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Link texts with 100 * shared shingles >= percent * all shingles of both, and number the components.

    Returns rid, rth (the row's identity), doc_id, n_shingles, component_id, kept, root (the component's least node;
    null without shingles).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = identified(docs)
    signed = stored(rows.select("rid", "rth", "doc_id", "text").mapInArrow(tidy(_sign(shingle, chunks_for(percent) * CHUNK)), SIGNED), "signed")
    full = signed.filter("n_shingles > 0")
    nodes = full.groupBy("v").agg(F.min(F.struct("rid", "rth", "n_shingles")).alias("row"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    clusters = stored(connected(_candidates(nodes.select("v", "sig"), percent)), "clusters")
    members = clusters.join(full.groupBy("v").agg(F.min(F.struct("rid", "rth", "n_shingles")).alias("row")), "v")
    blocks = stored(members.groupBy("root").agg(F.ceil(F.sum("row.n_shingles") / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")), "blocks")
    placed = spread_join(members, blocks, ["root"], "n").select("row.rid", "row.rth", "v", "root", "blocks", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"))
    dealt = rows.select("rid", "rth", "text").join(placed.hint("shuffle_hash"), ["rid", "rth"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("v", "root", "block", "text", other.alias("other")).select("v", "root", "block", "text", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    confirmed = dealt.repartition(parts, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(tidy(_confirm(shingle, percent)), "a binary, b binary")
    roots = connected(confirmed)
    texts = full.groupBy("v").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    least = stored(texts.join(roots, "v", "left").select("v", "least", "rows", F.coalesce("root", "v").alias("root")), "roots")
    groups = stored(least.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    component = stored(spread_join(least, groups, ["root"], "n").select("v", "rows", "root", "component_id"), "components")
    slim = ["rid", "rth", "doc_id", "n_shingles"]
    found = spread_join(full.select(*slim, "v"), component, ["v"], "rows").select(*slim, "component_id", "root")
    bare = signed.filter("n_shingles = 0").select(*slim, F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root"))
    return found.unionByName(bare).select(*slim, "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"), "root")


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row left of each group of near-duplicates: that of the least doc_id (null is the
    greatest), of these that of the least hash of its text; all its columns stay."""
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"__rid": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__rth": F.xxhash64(F.col("doc_id").cast("long"), text)})
    alone = F.when(F.col("n_shingles") == 0, F.struct("rid", "rth"))  # rows without shingles are no copies
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rth", "rid", "n_shingles")
    first = near_duplicates(docs, shingle, percent).groupBy("root", alone.alias("alone")).agg(F.min(order).alias("r"))
    kept = first.select(F.col("r.rid").alias("__rid"), F.col("r.rth").alias("__rth"), F.col("r.n_shingles").alias("__n"))
    joined = keyed.join(kept.hint("shuffle_hash"), ["__rid", "__rth"])
    # Rows equal in id and text are copies too: one stays, unless they are empty.
    return joined.withColumn("__one", F.when(F.col("__n") > 0, F.lit(0)).otherwise(F.monotonically_increasing_id())).dropDuplicates(["__rid", "__rth", "__one"]).select(*names)
