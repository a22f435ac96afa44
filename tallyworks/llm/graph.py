"""Connected components of an edge table by alternating stars, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, keep


def _mark(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.select(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(n), int(h)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest node reachable.

    Large-star and small-star rounds until nothing changes, a number that grows with the
    logarithm of the largest component. A hub's edges all have the hub as their key: its
    minimum is aggregated before the shuffle and written, so the join that follows is one of
    two plain tables, in which adaptive execution splits hot keys. Each round is a durable
    table, so lineage is one round deep, and the table before is deleted. Self loops and
    repeated edges are ignored; an empty table gives an empty table.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lows")
        large = both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, e = e, keep(small, "stars")
        done_with(old, lows)
        now = _mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(roots.join(e.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root")))
