"""Window operators over ordered lines, words, pages and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "sequence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: Column, before: Column, most: int = 5) -> DataFrame:
    """Rows in the frame of a marked row: the row before it if it is not marked and ``before`` holds, the marked row, and what follows up to the next marked one.

    A frame has at most ``most`` rows. Columns: df's, frame (the marked row's count in its
    key) and place (0 for the row before). A row may be in two frames: after one mark and
    before the next.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    within = Window.partitionBy(*keys, "_f").orderBy(*order)
    m = mark.cast("int")
    numbered = df.select("*", m.alias("_m"), F.sum(m).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_f"), F.lead(m).over(w).alias("_next"), before.alias("_b"))
    leads = numbered.withColumn("_lead", F.coalesce((F.col("_m") == 0) & (F.col("_next") == 1) & F.col("_b"), F.lit(False))).withColumn("_led", F.coalesce(F.lag("_lead").over(w), F.lit(False)))
    # a frame starts with its mark, so the first row knows whether a row before it belongs to the frame
    placed = leads.withColumn("_p", F.row_number().over(within)).withColumn("_has", F.first("_led").over(within))
    own = F.when((F.col("_f") > 0) & (F.col("_p") <= F.when(F.col("_has"), most - 1).otherwise(most)), F.struct(F.col("_f").alias("frame"), F.col("_p").alias("place")))
    ahead = F.when(F.col("_lead"), F.struct((F.coalesce("_f", F.lit(0)) + 1).alias("frame"), F.lit(0).alias("place")))
    return placed.select(*df.columns, F.explode(F.array_compact(F.array(own, ahead))).alias("_x")).select(*df.columns, "_x.frame", "_x.place")


def trailing_island(df: DataFrame, keys: Sequence[str], place: str, dense: Column) -> DataFrame:
    """Rows of the last run of consecutive dense places and of the consecutive places after it; all rows of a key without dense ones."""
    d = df.withColumn("_d", dense)
    w = Window.partitionBy(*keys).orderBy(place)
    islands = d.where("_d").withColumn("_i", F.col(place) - F.row_number().over(w))
    last = islands.groupBy(*keys, "_i").agg(F.min(place).alias("_from"), F.max(place).alias("_to")).groupBy(*keys).agg(F.max(F.struct("_to", "_from")).alias("_r"))
    joined = d.join(last, list(keys), "left")
    after = joined.withColumn("_run", F.col(place) - F.row_number().over(w))
    anchor = F.max(F.when(F.col(place) == F.col("_r._to"), F.col("_run"))).over(Window.partitionBy(*keys))
    keep = F.col("_r").isNull() | F.col(place).between(F.col("_r._from"), F.col("_r._to")) | ((F.col(place) > F.col("_r._to")) & (F.col("_run") == F.col("_anchor")))
    return after.withColumn("_anchor", anchor).where(keep).drop("_d", "_r", "_run", "_anchor")


def backward_stop(df: DataFrame, keys: Sequence[str], place: str, listed: Column, stop: int = 2, most: int = 64) -> DataFrame:
    """Rows that a scan from the last place reads: at most ``most``, ending with the ``stop``-th row in a row that is not listed once one was."""
    w = Window.partitionBy(*keys).orderBy(F.desc(place))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    a = df.withColumn("_l", listed.cast("int")).withColumn("_n", F.row_number().over(w)).withColumn("_found", F.max("_l").over(upto)).withColumn("_group", F.sum("_l").over(upto))
    run = F.sum(F.when(F.col("_l") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys, "_group").orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0))
    b = a.withColumn("_stop", F.when((F.col("_found") == 1) & (run >= stop), F.col("_n")))
    cut = F.min("_stop").over(Window.partitionBy(*keys))
    return b.withColumn("_cut", cut).where((F.col("_n") <= F.coalesce("_cut", F.lit(most))) & (F.col("_n") <= most)).drop("_l", "_n", "_found", "_group", "_stop", "_cut")


def midpoints(df: DataFrame, keys: Sequence[str], center: str, order: Sequence[str], edge: float = 0.5) -> DataFrame:
    """low and high bounds halfway to the neighbours; at the ends ``edge`` times the gap to the one neighbour."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c, p, n = F.col(center), F.lag(center).over(w), F.lead(center).over(w)
    low = F.coalesce((p + c) / 2, c - edge * (n - c), c)
    high = F.coalesce((c + n) / 2, c + edge * (c - p), c)
    return df.select("*", low.alias("low"), high.alias("high"))


def bands(df: DataFrame, keys: Sequence[str], place: str, gap: Column | float, least: int = 1) -> DataFrame:
    """(keys, band, first, last, n): runs of places no further than ``gap`` apart, of at least ``least`` rows."""
    w = Window.partitionBy(*keys).orderBy(place)
    new = F.when(F.col(place) - F.lag(place).over(w) > gap, 1).otherwise(0)
    banded = df.select(*keys, place, new.alias("_new")).select("*", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("band"))
    return banded.groupBy(*keys, "band").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def nearest_known(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], reach: int = 4) -> DataFrame:
    """before and after: the nearest non-null value within ``reach`` rows on either side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", F.last(value, ignorenulls=True).over(w.rowsBetween(-reach, -1)).alias("before"), F.first(value, ignorenulls=True).over(w.rowsBetween(1, reach)).alias("after"))


def unambiguous_best(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[Column | str], exact: Column) -> DataFrame:
    """The best row of each key, unless it is not exact and the next has the same score."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *order)
    ranked = df.select("*", F.row_number().over(w).alias("_n"), F.lead(score).over(w).alias("_next"))
    return ranked.where((F.col("_n") == 1) & (exact | F.col("_next").isNull() | (F.col("_next") < F.col(score)))).drop("_n", "_next")
