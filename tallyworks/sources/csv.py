"""Inventory files, read cell by cell as they were written, and the bulk files of a catalog."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import text as T

# Header names that mean a column, letters and digits only, first ones preferred.
HEADERS = {"part": ["part", "partnum", "partnumber"], "color": ["color", "colorid", "colour", "colourid"], "quantity": ["quantity", "qty", "count"], "spare": ["isspare", "spare"]}


def cells(content: str) -> list[list[str]]:
    """Rows of cells: quotes open and close anywhere, a doubled one inside is one, line ends inside stay; a blank last row is dropped."""
    rows, row, cell, quoted, i = [], [], [], False, 0
    while i < len(content):
        c = content[i]
        if quoted:
            if c == '"' and content[i + 1 : i + 2] == '"':
                cell.append(c)
                i += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"':
            quoted = True
        elif c == ",":
            row.append("".join(cell))
            cell = []
        elif c == "\n":
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        elif c != "\r":
            cell.append(c)
        i += 1
    rows.append([*row, "".join(cell)])
    if len(rows[-1]) == 1 and not rows[-1][0].strip():
        rows.pop()
    return rows


def places(header: list[str]) -> dict[str, int]:
    """Where each known column is; of equal headers the last counts."""
    names = {"".join(c for c in h.lower() if c.isascii() and c.isalnum()): i for i, h in enumerate(header)}
    return {k: next(names[a] for a in aliases if a in names) for k, aliases in HEADERS.items() if any(a in names for a in aliases)}


def inventory(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """(items, warnings) of inventory files: items(file, line, part, color, quantity, spare), warnings(file, line, message).

    A file without a part, colour or quantity column gives a warning and no rows, and so
    does one without rows; one of no bytes is not seen. Blank rows are skipped, rows without a part, colour or positive quantity
    with a warning. Files are small and read whole, one a row, in parallel.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, content in zip(pdf["file"], pdf["value"], strict=True):
                rows = cells(content or "")
                at = places(rows[0]) if rows else {}
                missing = [k for k in ("part", "color", "quantity") if k not in at]
                if missing or len(rows) < 2:
                    out.append((file, 0, None, None, None, None, f"missing columns: {', '.join(missing)}" if missing else "no rows"))
                    continue
                for n, r in enumerate(rows[1:], 2):
                    if any(c.strip() for c in r):
                        out.append((file, n, *(r[at[k]] if k in at and at[k] < len(r) else None for k in HEADERS), None))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="int32" if c == "line" else object) for i, c in enumerate(("file", "line", "part", "color", "quantity", "spare", "message"))})

    found = raw.mapInPandas(parse, "file string, line int, part string, color string, quantity string, spare string, message string")
    items = found.where("message is null").select("file", "line", F.nullif(T.part_number(F.coalesce("part", F.lit(""))), F.lit("")).alias("part"), T.blank_as_null(F.col("color")).alias("color"), T.leading_integer(F.col("quantity")).alias("quantity"), T.truth(F.coalesce("spare", F.lit(""))).alias("spare"))
    good = F.col("part").isNotNull() & F.col("color").isNotNull() & F.col("quantity").isNotNull()
    return items.where(good), found.where("message is not null").select("file", "line", "message").unionByName(items.where(~good).select("file", "line", F.lit("incomplete row").alias("message")))


def bulk(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a (compressed) bulk file, as strings, blank values as null, with the file's order o; quoted line ends stay in their cells; a .gz file is one task, so it is dealt out again."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    there = {c.strip(): c for c in df.columns}
    return df.select(*[(T.blank_as_null(F.col(f"`{there[c]}`")) if c in there else F.lit(None).cast("string")).alias(c) for c in columns], F.monotonically_increasing_id().alias("o")).repartition(spark.sparkContext.defaultParallelism)
