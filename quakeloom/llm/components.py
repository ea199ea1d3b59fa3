"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with an edge to another node; root is the component's smallest node.

    edges: columns a and b of one orderable type. Loops and nulls are ignored, repeats and directions don't
    matter. Every step is a groupBy-min and a join, so a hub's neighbours are never gathered in one task.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = materialize(small.select("e.*").filter("a <> b").distinct(), "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
