"""Bags of consecutive work steps, their statistics, and reconciliation of quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pieces aimed at and accepted, callouts and load, soft and hard; weight of a callout.
TARGET, ACCEPT, CALLOUTS, LOAD, CALLOUT_WEIGHT = 50, (40, 60), (28, 35), (80.0, 95.0), 1.25


def allocate(steps: DataFrame, target: int = TARGET, accept: tuple[int, int] = ACCEPT) -> DataFrame:
    """steps(manual_id, step, pieces, callouts) with bag: consecutive bags that split no step.

    A bag closes before a step that would take it over the accepted size or a hard limit,
    or over a soft limit once the accepted size is reached, or past the target by more than
    it is short of it. A last bag under the accepted size joins the one before if that
    breaks no hard limit. A manual's steps are few: they are folded in one array.
    """

    p, c = lambda a, x: a["p"] + x["pieces"], lambda a, x: a["c"] + x["callouts"]

    def step(a: Column, x: Column) -> Column:
        load = p(a, x) + CALLOUT_WEIGHT * c(a, x)
        hard = (p(a, x) > accept[1]) | (c(a, x) > CALLOUTS[1]) | (load > LOAD[1])
        soft = (a["p"] >= accept[0]) & ((c(a, x) > CALLOUTS[0]) | (load > LOAD[0]) | (F.abs(p(a, x) - target) > F.abs(a["p"] - target)))
        new = (a["p"] > 0) & (hard | soft)
        bag = F.when(new, a["bag"] + 1).otherwise(a["bag"])
        return F.struct(
            bag.alias("bag"), F.when(new, x["pieces"]).otherwise(p(a, x)).alias("p"), F.when(new, x["callouts"]).otherwise(c(a, x)).alias("c"),
            F.when(new, a["p"]).otherwise(a["q"]).alias("q"), F.when(new, a["c"]).otherwise(a["d"]).alias("d"), F.concat(a["bags"], F.array(bag)).alias("bags"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(1).alias("bag"), zero.alias("p"), zero.alias("c"), zero.alias("q"), zero.alias("d"), F.array().cast("array<int>").alias("bags"))
    ordered = F.sort_array(F.collect_list(F.struct("step", F.col("pieces").cast("long").alias("pieces"), F.col("callouts").cast("long").alias("callouts"))))
    folded = steps.groupBy("manual_id").agg(ordered.alias("steps")).select("manual_id", "steps", F.aggregate("steps", start, step).alias("a"))
    both, calls = F.col("a.p") + F.col("a.q"), F.col("a.c") + F.col("a.d")
    joins = (F.col("a.bag") > 1) & (F.col("a.p") < accept[0]) & (both <= accept[1]) & (calls <= CALLOUTS[1]) & (both + CALLOUT_WEIGHT * calls <= LOAD[1])
    most = F.when(joins, F.col("a.bag") - 1).otherwise(F.col("a.bag"))
    rows = folded.select("manual_id", most.alias("most"), F.explode(F.arrays_zip("steps", F.col("a.bags").alias("bags"))).alias("x"))
    return rows.select("manual_id", "x.steps.*", F.least(F.col("x.bags"), F.col("most")).alias("bag"))


def inside_fences(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles of their key; quartiles are exact and interpolated."""
    q = df.groupBy(*keys).agg(F.percentile(value, 0.25).alias("_a"), F.percentile(value, 0.75).alias("_b"))
    low, high = F.col("_a") - 1.5 * (F.col("_b") - F.col("_a")), F.col("_b") + 1.5 * (F.col("_b") - F.col("_a"))
    return df.join(q, keys).where(F.col(value).between(low, high)).drop("_a", "_b")


def reconciliation(needed: Column, assigned: Column, unresolved: Column) -> Column:
    """green if all is assigned, yellow if the rest is known to be unresolved, else red."""
    n, a, u = (F.coalesce(c, F.lit(0)) for c in (needed, assigned, unresolved))
    return F.when((a == n) & (u == 0), "green").when((a <= n) & (a + u >= n), "yellow").otherwise("red")
