"""Mixing sources to target weights by pivotal dependent rounding; DataFrame operations only.

A document of a source with target T and size S is to be taken T / S times: that many whole copies, and the rest as a
fraction. Fractions are rounded by the pivotal method, with words as the mass: two documents at a time, mass moves from one to
the other, in a random direction that keeps both expectations, until one of them has none or all of its words. So
a source's total never changes, but for its last document.

Documents meet in groups of about ``GROUP``, dealt by hash within their source; a group's fold leaves one document
undecided, and these residuals meet again on the next level: a reduction tree of depth log(n) / log(GROUP). All
random numbers are hashes of doc_id, text length, level and seed, so reruns agree, whatever the partitions.

Defined cases: null text has size 0 and is taken 0 times. A null source is a source of its own, the last one. Rows
with equal doc_id, source and size are told apart by their number. A source of size 0 has target 0. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import stored, word_count

#: Weights of the sources by rank, repeating.
WEIGHTS = (3, 1, 2)
GROUP = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: float = 2.0) -> DataFrame:
    """Per source (null-safe key ``source``): source_size and target.

    ``sizes`` has source and size. The sum of all targets is ``percent`` of all sizes, shared by weight, with a
    target stopping at ``most`` times its source's size and the excess shared anew. The level at which that comes to
    rest is found in one pass over the sources by their size for each weight. One row for each source is ordered here.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    table = table.withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(most)
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    capped = table.select(
        "source", "source_size", "weight", cap.alias("cap"),
        (F.sum("source_size").over(everything) * F.lit(percent / 100)).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    # The level with all smaller ones at their cap; the first source that is below its own cap at it sets it for the rest.
    placed = capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    rest = placed.withColumn("rest", F.min(F.when(F.col("open"), F.struct("cap_before", "level"))).over(everything))
    share = F.least(F.col("cap"), F.coalesce(F.col("rest.level") * F.col("weight"), F.col("cap")))
    return rest.select("source", "source_size", share.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _fold(level: int, seed: int) -> tuple[Column, Column]:
    """For ``members`` (structs of uid, size, mass): those decided, and the one left (null if none is)."""
    kind = "struct<left:struct<uid:long,size:long,mass:double>,done:array<struct<uid:long,full:boolean>>>"
    start = F.from_json(F.lit('{"done":[]}'), kind)

    def step(state: Column, x: Column) -> Column:
        left, done = state["left"], state["done"]
        up = F.least(left["size"] - left["mass"], x["mass"])  # what the held one can gain
        down = F.least(left["mass"], x["size"] - x["mass"])  # what it can give
        gains = _uniform(left["uid"], x["uid"], F.lit(level), F.lit(seed)) * (up + down) < down
        held = F.when(gains, left["mass"] + up).otherwise(left["mass"] - down)
        given = F.when(gains, x["mass"] - up).otherwise(x["mass"] + down)
        # After a gain the held one is full or the other empty; after a gift the held one is empty or the other full.
        held_done = F.when(gains, left["size"] - left["mass"] <= x["mass"]).otherwise(left["mass"] <= x["size"] - x["mass"])
        ready = F.when(held_done, F.struct(left["uid"].alias("uid"), gains.alias("full"))).otherwise(F.struct(x["uid"].alias("uid"), (~gains).alias("full")))
        stays = F.when(held_done, F.struct(x["uid"].alias("uid"), x["size"].alias("size"), given.alias("mass"))).otherwise(
            F.struct(left["uid"].alias("uid"), left["size"].alias("size"), held.alias("mass"))
        )
        first = F.struct(F.struct(x["uid"].alias("uid"), x["size"].alias("size"), x["mass"].alias("mass")).alias("left"), done.alias("done"))
        return F.when(left.isNull(), first).otherwise(F.struct(stays.alias("left"), F.concat(done, F.array(ready)).alias("done"))).cast(kind)

    folded = F.aggregate("members", start, step)
    return folded["done"], folded["left"]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: float = 2.0, seed: int = 1) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken, and ``rth``, a hash of id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rth"))
    number = F.row_number().over(Window.partitionBy("doc_id", "rth").orderBy("source"))
    base = stored(base.withColumn("uid", F.xxhash64("doc_id", "rth", "source", number)), "sizes")
    targets = stored(source_targets(base, weights, percent, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = base.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rated = joined.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio"))
    rated = rated.withColumn("mass", F.col("size") * (F.col("ratio") - F.col("whole")))
    open_ = rated.filter("mass > 0 AND mass < size").select("uid", "source", "size", "mass")
    decided = None
    for level in range(64):
        counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        grouped = open_.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        group = F.pmod(F.xxhash64("uid", F.lit(level), F.lit(seed)), F.ceil(F.col("n") / GROUP))
        grouped = grouped.groupBy("source", group.alias("g")).agg(F.sort_array(F.collect_list(F.struct("uid", "size", "mass"))).alias("members"))
        done, left = _fold(level, seed)
        folded = stored(grouped.select("source", done.alias("done"), left.alias("left")), "rounded")
        made = folded.select(F.explode("done").alias("d")).select("d.uid", F.col("d.full").alias("full"))
        decided = made if decided is None else decided.unionByName(made)
        open_ = folded.filter("left IS NOT NULL").select("left.uid", "source", "left.size", "left.mass")
        if not open_.groupBy("source").count().filter("count > 1").limit(1).count():
            break
    # The last one of a source: rounded at random, by its own fraction.
    last = open_.select("uid", (_uniform(F.col("uid"), F.lit(seed)) * F.col("size") < F.col("mass")).alias("full"))
    decided = decided.unionByName(last)
    # A mass of all the words, by rounding error, is a copy as well.
    extra = F.when(F.coalesce("full", F.col("mass") >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("int")
    # What is decided grows with the documents, so it must not be broadcast on a low estimate.
    out = rated.join(decided.hint("merge"), "uid", "left").withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rth")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all its columns kept."""
    names = docs.columns
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    taken = mix(docs, **how).filter("copies > 0").select(F.col("rth").alias("__rth"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("__source"), "copies")
    # Rows equal in id, text and source are one row here, taken as often as they are together.
    taken = taken.groupBy("__rth", "__source").agg(F.sum("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), key.alias("__rth"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("__source"))
    joined = rows.dropDuplicates(["__rth", "__source"]).join(taken.hint("shuffle_hash"), ["__rth", "__source"])
    return joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
