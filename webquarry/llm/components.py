"""Connected components of large edge tables by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each ``a``, or itself; written, so that the join with it can split hot keys."""
    return materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node that can be reached) for each node of ``edges(a, b)``.

    Large-star: every greater neighbour of a node is tied to the node's least neighbour.  Small-star: every smaller
    one, and the node, likewise.  Each round is written to the shared folder; they end when one changes nothing, after a
    number that grows with the logarithm of the longest path.  Self-loops and repeated edges are allowed; without edges the result is empty.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least2 = _least(down)
        met = down.join(least2, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least2.select("a", F.col("m").alias("b"))).filter("a <> b")
        new = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        release(now, least, large, least2)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    tied = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = tied.select(F.col("component").alias("node"), "component").distinct()
    return tied.unionByName(roots)
