"""Recognised words as tab-separated rows, lines assembled from them, and what regions they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import text as T
from tallyworks.operators import geometry

#: A page as nested JSON: blocks of paragraphs of lines of words, and its plain text.
_BOX = "bbox STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
NESTED = f"blocks ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<lines: ARRAY<STRUCT<text: STRING, confidence: DOUBLE, {_BOX.replace(' ', ': ', 1)}, words: ARRAY<STRUCT<text: STRING, confidence: DOUBLE, {_BOX.replace(' ', ': ', 1)}>>>>>>>>, text STRING, confidence DOUBLE"

COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf"]
WORD = 5


def _number(c: Column) -> Column:
    """A number; an empty cell is 0, other text null."""
    t = F.trim(c)
    return F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_num, block_num, par_num, line_num, word_num, text, confidence, x0, y0, x1, y1) of the word rows.

    The header row, if there, is no word; a text may hold tabs; confidence below 0 is null,
    else rounded; rows with other text for a number, or none for a word, are left out.
    """
    f = F.split(F.col("value"), "\t", -1)
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), f.alias("f")).where(F.trim(F.get("f", F.lit(0))) == str(WORD))
    cell = {c: _number(F.get("f", F.lit(i))) for i, c in enumerate(COLUMNS)}
    text = T.trimmed(F.array_join(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), "\t"))
    typed = raw.select("file", *[cell[c].alias(c) for c in COLUMNS[1:]], text.alias("text")).where("text <> ''").dropna(subset=["left", "top", "width", "height"])
    return typed.select("file", *[F.col(c).cast("int").alias(c) for c in COLUMNS[1:6]], "text", F.when(F.col("conf") >= 0, T.half_up(F.col("conf")).cast("int")).alias("confidence"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a line joined in order, with mean confidence and the hull of their boxes."""
    line = [*keys, "block_num", "par_num", "line_num"]
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_num", "x0", "text"))), lambda x: x["text"]), " ")
    return words.groupBy(*line).agg(joined.alias("text"), T.half_up(F.avg("confidence")).cast("int").alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _inner(outer: Column, name: str) -> Column:
    """The arrays of that name in an array of structs, as one array; null ones are left out."""
    return F.flatten(F.transform(F.filter(outer, lambda x: x[name].isNotNull()), lambda x: x[name]))


def _block_lines(page: Column) -> Column:
    return _inner(_inner(page["blocks"], "paragraphs"), "lines")


def _traced(rows: DataFrame, item: str) -> Column:
    box = F.col(f"{item}.bbox")
    return F.when(box.isNotNull(), geometry.traced(box, F.col("regions"))) if "regions" in rows.columns else box


def nested_words(pages: DataFrame) -> DataFrame:
    """(page_number, nth, text, confidence, x0, y0, x1, y1) of the words in pages(page_number, data, perhaps regions), data nested JSON.

    In the order of the data, nth counted over all words of a page. Words without text or
    box, or in none of the page's regions, are left out; data that is no such JSON has none.
    """
    page = pages.withColumn("_p", F.from_json("data", NESTED))
    each = page.select("page_number", *[c for c in ["regions"] if c in pages.columns], F.posexplode(_inner(_block_lines(F.col("_p")), "words")).alias("nth", "w"))
    placed = each.select("page_number", "nth", F.col("w.text").alias("text"), F.col("w.confidence").alias("confidence"), _traced(each, "w").alias("b"))
    return placed.where(F.col("text").rlike(T.NOT_BLANK) & F.col("b").isNotNull()).select("page_number", "nth", "text", "confidence", "b.x0", "b.y0", "b.x1", "b.y1")


def nested_lines(pages: DataFrame) -> DataFrame:
    """(page_number, nth, text, confidence, x0, y0, x1, y1) of the lines in pages like those of nested_words.

    Lines of blocks, or where a page has none the lines of its plain text, with the page's
    confidence and no box. Blank lines are left out; a line in none of the regions stays, without a box.
    """
    page = pages.withColumn("_p", F.from_json("data", NESTED))
    blocks = F.transform(_block_lines(F.col("_p")), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("bbox")))
    empty = F.lit(None).cast(f"STRUCT<{_BOX.replace(' ', ': ', 1)}>")["bbox"]
    plain = F.transform(F.split(F.col("_p.text"), "\r?\n", -1), lambda x: F.struct(x.alias("text"), F.col("_p.confidence").alias("confidence"), empty.alias("bbox")))
    each = page.select("page_number", *[c for c in ["regions"] if c in pages.columns], F.posexplode(F.when(F.size(blocks) > 0, blocks).otherwise(plain)).alias("nth", "l"))
    return each.select("page_number", "nth", F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), _traced(each, "l").alias("b")).where(F.col("text").rlike(T.NOT_BLANK)).select("page_number", "nth", "text", "confidence", "b.x0", "b.y0", "b.x1", "b.y1")


def first_source(*frames: DataFrame, key: str = "page_number") -> DataFrame:
    """Rows of the first table that has any for a page: rows of words, else of blocks, else of plain text."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f.join(out.select(key).distinct(), key, "left_anti"))
    return out


def is_pdf(content: Column) -> Column:
    """The signature is within the first 1024 bytes."""
    return F.contains(F.substring(content, 1, 1024), F.lit(bytearray(b"%PDF-")))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """PDF files below a path with their metadata; others by name or by content are left out."""
    return spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".pdf") & is_pdf(F.col("content"))).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
