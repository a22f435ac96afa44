"""Structure of a manual: page classes, where the parts list begins, work steps, decisions of reviewers, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions import text as T
from tallyworks.operators import relational

#: Rows that make a page look like a list, and pages that make a list stable.
LISTED, STABLE = 8, 1
STEP = rf"(?i)^(?:step\s*)?([0-9]{{1,4}})$"


def page_classes(lines: DataFrame) -> DataFrame:
    """(manual_id, page_number, kind, confidence, header, part_lines, step) of lines(manual_id, page_number, line_index, text).

    parts-list by header or many part lines, instruction by a step number, cover for a first
    page with neither, else other; confidence grows with the signals that agree.
    """
    text = T.line(F.coalesce("text", F.lit("")))
    step = T.leading_integer(F.nullif(F.regexp_extract(text, STEP, 1), F.lit("")))
    pages = lines.groupBy("manual_id", "page_number").agg(F.bool_or(T.is_header(text)).alias("header"), F.count_if(T.has_part_number(text)).alias("part_lines"), F.min(step).alias("step"))
    listed = (F.col("header") & (F.col("part_lines") > 0)) | (F.col("part_lines") >= LISTED)
    kind = F.when(listed, "parts-list").when(F.col("step").isNotNull(), "instruction").when(F.col("page_number") == 1, "cover").otherwise("other")
    sure = F.when(listed, F.least(F.lit(1.0), 0.5 + 0.25 * F.col("header").cast("int") + F.col("part_lines") / 32)).when(F.col("step").isNotNull(), 0.8).otherwise(0.5)
    return pages.select("manual_id", "page_number", kind.alias("kind"), sure.alias("confidence"), "header", "part_lines", "step")


def list_start(pages: DataFrame, stable: int = STABLE) -> DataFrame:
    """(manual_id, first, last): the first run of at least ``stable`` list pages after the last instruction page."""
    last = pages.groupBy("manual_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "instruction", F.col("page_number"))), F.lit(0)).alias("after"))
    w = Window.partitionBy("manual_id").orderBy("page_number")
    run = pages.where("kind = 'parts-list'").join(last, "manual_id").where("page_number > after").withColumn("run", F.col("page_number") - F.row_number().over(w))
    runs = run.groupBy("manual_id", "run").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= stable)
    return runs.groupBy("manual_id").agg(F.min("first").alias("first"), F.min_by("last", "first").alias("last"))


def steps(pages: DataFrame) -> DataFrame:
    """Instruction pages with a step that goes on from the step before: steps that go back are marked out of order."""
    w = Window.partitionBy("manual_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    s = pages.where("kind = 'instruction'")
    return s.select("manual_id", "page_number", "step", F.concat_ws("-", F.col("manual_id").cast("string"), F.lit("step"), F.col("step").cast("string")).alias("step_key"), (F.col("step") > F.coalesce(F.max("step").over(w), F.lit(0))).alias("in_order"))


def callout_steps(callouts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each callout (manual_id, page_number, callout, x, y) with the nearest step anchor (step, ax, ay) of its page."""
    d = F.sqrt(F.pow(F.col("x") - F.col("ax"), F.lit(2)) + F.pow(F.col("y") - F.col("ay"), F.lit(2)))
    near = callouts.join(anchors, ["manual_id", "page_number"]).groupBy("manual_id", "page_number", "callout").agg(F.min(F.struct(d.alias("d"), "step")).alias("b"))
    return near.select("manual_id", "page_number", "callout", F.col("b.step").alias("step"))


def decided(items: DataFrame, decisions: DataFrame, field: str) -> DataFrame:
    """Items with a field as the last review decision (manual_id, sequence, field, after, at) has it."""
    last = relational.last_writer(decisions.where(F.col("field") == field), ["manual_id", "sequence"], ["after"], "at")
    return items.join(last, ["manual_id", "sequence"], "left").withColumn(field, F.coalesce(F.col("after").cast(dict(items.dtypes)[field]), field)).drop("after")


def export_bags(rows: DataFrame, folder: str) -> None:
    """Bags' rows as CSV, a folder for each manual and bag."""
    rows.repartition("manual_id", "bag").write.mode("overwrite").partitionBy("manual_id", "bag").option("header", True).csv(folder)


def fresh(known: DataFrame, found: DataFrame, keys: list[str]) -> bool:
    """Whether every source (source, ...) that is found has the metadata that is known of it."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    before = known.select("source", *[F.col(k).alias(f"_{k}") for k in keys], F.lit(1).alias("_there"))
    return found.join(before, "source", "left").where(F.col("_there").isNull() | ~same).isEmpty()
