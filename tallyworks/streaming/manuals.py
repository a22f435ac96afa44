"""New manuals as a stream of their lines: each micro-batch is extracted as the batch plan does it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyworks.plans import flagship

LINES = "manual_id string, page_number int, line_index int, text string, confidence double"


def start(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Extract the part rows of every file of lines that appears in source; a manual is whole in one file, so no state outlives a batch.

    The batch number names the output folder and overwrites it, so a batch that runs again leaves one copy.
    """

    def batch(lines: DataFrame, number: int) -> None:
        flagship.extract(lines).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(LINES).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
