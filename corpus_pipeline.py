"""A corpus pipeline of five stages, each on what its predecessor kept.

run(spark, sf_dir) applies STAGES to the documents table. Each stage takes (spark, docs,
sf_dir); its result is written and read again as the next one's docs. The filtering
stages keep whole rows, so columns of any name pass through; the last one returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm import contamination, packing, secrets, simhash, toxicity
from tallyworks.llm.common import columns, keep, small_batches, table, text_of


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids; rows without an id stay."""
    return docs.join(ids.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").select(*columns(docs))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted toxic; the classifier learns from the labels of docs."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, one of those with the smallest doc_id; rows without an id stay only where no row of the group has one."""
    small_batches(spark)
    # written, so that a row keeps its number
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", simhash.fingerprint_of(text_of(docs)).alias("fp"), F.struct(*columns(docs)).alias("d")), "rows")
    roots = simhash.names(rows.select("doc_id", "fp")).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    kept = rows.select("doc_id", "row", "fp").join(roots, "fp").groupBy("root").agg(first.alias("w")).select(F.col("w.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("d.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item or a paraphrase of one."""
    return _without(docs, contamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in a text; the documents stay, n_chars follows the new text."""
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.digest(packing.pack(docs, packing.tokenizer_path()))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Classifiers, fingerprints and tokenizers are not SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
