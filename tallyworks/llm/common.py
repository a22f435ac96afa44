"""Shared helpers: reading tables, durable intermediate tables, batch size, word rules.

Words are maximal runs of characters other than space and \\t-\\r, which is what
``bytes.split()`` cuts, and ``bytes.lower()`` folds A-Z only; every operator that
works on words in Python therefore works on UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.sources.durable import keep, shared_dir  # noqa: F401

#: Rows in an Arrow batch: texts may be long, so a batch must be few rows.
BATCH_ROWS = 256
#: Java regex for the white space that separates words.
SPACE = r"[ \t-\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[name], F.lit(""))


def columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts holds; a runtime setting of the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def done_with(*kept: DataFrame) -> None:
    """Delete durable tables that nothing reads any more."""
    for df in kept:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
