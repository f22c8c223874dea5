"""Connected components of an edge table, by alternating large and small stars.

Each round sends every node's larger neighbours to the least of its neighbourhood, then its smaller ones. Both steps
are a minimum by node (summed before the shuffle) and a join that deals the edges of nodes with many over many
tasks, so a node with a third of all edges is no bottleneck.
Rounds are written to the shared folder. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import spread_join, stored


def connected(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of ``edges`` (a, b: of one type with an order) that has a neighbour; root is the component's least node.

    Loops, repeated edges and empty tables are fine; nulls are ignored.
    """
    kept = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = tuple(kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = spread_join(both, least, ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large, "edges")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = spread_join(large, least, ["a"], "n").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        kept = stored(small.distinct(), "edges")
    return kept.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(kept.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
