"""Connected components by alternating star contraction.

Every round rewrites each edge through the smallest neighbour of its end points
(large star, then small star) until only stars around the smallest node of each
component remain; the number of rounds grows with the logarithm of the diameter.
Neighbourhoods are never gathered: the smallest neighbour is a map-side combined
aggregate, and it meets the edges in a join of which both sides are shuffled, so that
adaptive execution splits a hub of any degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votegrid.storage import Scratch


def _through_smallest(edges: DataFrame) -> DataFrame:
    """Columns u, v, m: each edge with the smallest neighbour of u (or u itself)."""
    smallest = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("best"))
    # the hash is a second key only so that the aggregate is shuffled again: skewed
    # joins are split where both sides come straight from a shuffle
    smallest = smallest.select("c", F.least("c", "best").alias("m"), F.xxhash64("c").alias("hc"))
    return edges.withColumn("hu", F.xxhash64("u")).join(
        smallest, (F.col("u") == F.col("c")) & (F.col("hu") == F.col("hc"))
    ).select("u", "v", "m")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``: the root is the smallest node
    that can be reached.  Nodes without an edge are not listed; self-loops and
    repeated edges are harmless; no edges give an empty table."""
    now = scratch.stage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges0",
    )
    before = None
    for turn in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _through_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        linked = _through_smallest(large)
        small = (
            linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(linked.where("u <> m").select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = scratch.stage(small, f"edges{turn}")
        sums = after.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"),
        ).first()
        scratch.drop(f"edges{turn - 1}")
        now = after
        if (sums.n, sums.h) == before:
            break
        before = (sums.n, sums.h)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
