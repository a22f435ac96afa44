"""Project documents: checked for what must not be stored, one partition a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.sources.catalog import file_system

# Names of what holds a document's bytes, images or text, which must not be stored.
FORBIDDEN = ["arrayBuffer", "bytes", "crop", "crops", "file", "manualBytes", "manualFile", "ocrLines", "ocrText", "pageImage", "pageImages", "pdfBytes", "rawText", "rawOcr", "rawOcrOutput", "renderedPage", "renderedPages", "sourceText", "textLines"]
_FORBIDDEN = frozenset(n.lower() for n in FORBIDDEN)
# The parts of an empty project, and what is kept of a document.
SCHEMA_VERSION = 1
LISTS = ["inventory_rows", "catalog_matches", "validation_reports", "bag_splits", "review_decisions"]
METADATA = ["file_name", "file_size", "file_type", "last_modified", "page_count"]


def empty(ids: DataFrame) -> DataFrame:
    """A project without anything for each project_id: a version, the time, empty lists as JSON, no manual and no export settings."""
    manual = F.lit(None).cast("struct<file_name: string, file_size: bigint, file_type: string, last_modified: bigint, page_count: int>")
    return ids.select("project_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("updated_at"), manual.alias("manual"), *[F.array().cast("array<string>").alias(c) for c in LISTS], F.lit(None).cast("string").alias("export_settings"))


def with_manual(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects with what may be kept of their documents(project_id, ...), METADATA only; the others stay as they are."""
    kind = projects.schema["manual"].dataType
    meta = documents.select("project_id", F.struct(*[F.col(c).cast(kind[c].dataType).alias(c) for c in METADATA]).alias("_m"))
    joined = projects.join(meta, "project_id", "left")
    there = F.col("_m").isNotNull()
    return joined.select(*[F.coalesce("_m", "manual").alias(c) if c == "manual" else F.when(there, F.current_timestamp()).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in projects.columns])


def violations(schema: T.DataType, path: str = "$") -> list[str]:
    """Paths of binary fields and of fields with forbidden names."""
    if isinstance(schema, T.StructType):
        found = [f"{path}.{f.name}" for f in schema.fields if f.name.lower().replace("_", "") in _FORBIDDEN]
        return found + [v for f in schema.fields for v in violations(f.dataType, f"{path}.{f.name}")]
    if isinstance(schema, T.ArrayType):
        return violations(schema.elementType, f"{path}[]")
    if isinstance(schema, T.MapType):
        return violations(schema.valueType, f"{path}{{}}")
    return [path] if isinstance(schema, T.BinaryType) else []


def save(projects: DataFrame, root: str) -> None:
    """Put projects(project_id, ...): those given replace their versions, others stay."""
    if bad := violations(projects.schema):
        raise ValueError(f"not to be stored: {', '.join(bad)}")
    projects.write.mode("overwrite").partitionBy("project_id").option("partitionOverwriteMode", "dynamic").parquet(root)


def load(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    df = spark.read.parquet(root)
    return df.where(df["project_id"] == project_id)


def delete(spark: SparkSession, root: str, project_id: str) -> bool:
    """Take a project away; whether there was one."""
    fs, path = file_system(spark, f"{root}/project_id={project_id}")
    return fs.delete(path, True)
