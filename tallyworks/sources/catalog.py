"""A parts catalog: its tables from bulk files and from service payloads, published as versions."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions import text as T
from tallyworks.operators import relational
from tallyworks.sources.csv import bulk

SCHEMA_VERSION = 5
MOST_KEYS = 1000


def build(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables color, part, element and alias of the four bulk files in a folder.

    Of equal keys the last row wins (a colour keeps an earlier rgb if the last has none);
    elements of a part and colour are distinct, in file order; the first relation of a pair
    of parts wins, A and M hold both ways, P from child to parent.
    """
    ordered = lambda name, cols: bulk(spark, f"{folder}/{name}.csv.gz", cols)
    colors = ordered("colors", ["id", "name", "rgb"]).dropna(subset=["id", "name"])
    color = relational.last_known(colors, ["id"], ["name", "rgb"], "o")
    parts = ordered("parts", ["part_num", "name"]).withColumn("part_num", T.part_number(F.col("part_num"))).dropna(subset=["part_num"])
    part = relational.last_writer(parts, ["part_num"], ["name"], "o")
    elements = ordered("elements", ["element_id", "part_num", "color_id"]).dropna().withColumn("part_num", T.part_number(F.col("part_num"))).where(F.col("element_id").rlike("^[A-Za-z0-9._-]+$"))
    element = relational.ordered_lists(elements, ["part_num", "color_id"], "element_id", "o", "element_ids")
    relations = ordered("part_relationships", ["rel_type", "child_part_num", "parent_part_num"]).dropna().select(F.col("rel_type").alias("kind"), T.part_number(F.col("child_part_num")).alias("child"), T.part_number(F.col("parent_part_num")).alias("parent"), "o").where(F.col("kind").isin("A", "M", "P"))
    alias = relational.alias_lists(relations, "o").select("part", "alias", F.lit("relationship").alias("kind"), F.col("kind").alias("source"))
    return {"color": color, "part": part, "element": element, "alias": alias}


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write tables to a new folder below root, then name it in a new pointer file: readers see the old version or the new one, whole.

    Pointers are numbered and never replaced, and the highest counts: there is no moment without one.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    meta = json.dumps({"schema_version": SCHEMA_VERSION, "version": version, "tables": sorted(tables)})
    fs, temporary = file_system(spark, f"{root}/_pointer-{version}")
    out = fs.create(temporary, True)
    out.write(bytearray(meta.encode()))
    out.close()
    for _ in range(100):
        _, pointer = file_system(spark, f"{root}/POINTER-{_latest(spark, root) + 1:08d}")
        # fails where another writer took the number
        if not fs.exists(pointer) and fs.rename(temporary, pointer):
            return version
    raise OSError(f"cannot publish {root}")


def _latest(spark: SparkSession, root: str) -> int:
    """Number of the newest pointer, 0 without one."""
    fs, pattern = file_system(spark, f"{root}/POINTER-*")
    return max((int(f.getPath().getName().split("-")[1]) for f in fs.globStatus(pattern) or []), default=0)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The published tables, or None if there are none of this schema version."""
    number = _latest(spark, root)
    if not number:
        return None
    meta = json.loads(spark.read.text(f"{root}/POINTER-{number:08d}", wholetext=True).first()[0])
    if meta.get("schema_version") != SCHEMA_VERSION:
        return None
    return {t: spark.read.parquet(f"{root}/{meta['version']}/{t}") for t in meta["tables"]}


def lookup(catalog: dict[str, DataFrame], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, missing) of requested numbers; more than MOST_KEYS distinct ones are refused."""
    k = keys.select(T.part_number(F.col("part_num")).alias("part_num")).where("part_num <> ''").distinct()
    if k.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"at most {MOST_KEYS} part numbers a request")
    bounded = F.broadcast(k)  # MOST_KEYS rows at most
    parts = catalog["part"].join(bounded, "part_num", "left_semi")
    aliases = catalog["alias"].join(bounded.withColumnRenamed("part_num", "part"), "part", "left_semi")
    known = parts.select("part_num").unionByName(aliases.select(F.col("part").alias("part_num"))).distinct()
    return parts.join(aliases.groupBy(F.col("part").alias("part_num")).agg(F.sort_array(F.collect_list(F.struct("alias", "kind", "source"))).alias("aliases")), "part_num", "left"), k.join(known, "part_num", "left_anti")


def payload_parts(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(part_num, name, url, image_url, aliases) of service payloads: {results: [...]}, an array, or one object.

    Rows without a number are left out. Aliases come from print_of, from external ids in any
    of their shapes, and from relationships; each number once, never the part's own.
    """
    v = F.try_parse_json(F.col(column))
    get = lambda x, p: F.try_variant_get(x, p, "string")
    results = F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    p = payloads.select(F.explode(results).alias("p"))
    ids = F.coalesce(F.try_variant_get(F.col("p"), "$.external_ids", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    many = lambda x: F.coalesce(F.try_variant_get(x, "$.ext_ids", "array<string>"), F.try_variant_get(x, "$", "array<string>"), F.array(get(x, "$")))
    external = F.flatten(F.transform(F.map_entries(ids), lambda e: F.transform(many(e["value"]), lambda n: F.struct(T.part_number(n).alias("number"), F.lit("external").alias("kind"), e["key"].alias("source")))))
    related = F.transform(F.coalesce(F.try_variant_get(F.col("p"), "$.relationships", "array<variant>"), F.array().cast("array<variant>")), lambda r: F.struct(T.part_number(F.coalesce(get(r, "$.child_part_num"), get(r, "$.parent_part_num"), get(r, "$.part_num"))).alias("number"), F.lit("relationship").alias("kind"), F.coalesce(get(r, "$.rel_type"), F.lit("")).alias("source")))
    printed = F.array(F.struct(T.part_number(get(F.col("p"), "$.print_of")).alias("number"), F.lit("print").alias("kind"), F.lit("catalog").alias("source")))
    base = p.select(T.part_number(get(F.col("p"), "$.part_num")).alias("part_num"), get(F.col("p"), "$.name").alias("name"), get(F.col("p"), "$.part_url").alias("url"), get(F.col("p"), "$.part_img_url").alias("image_url"), F.concat(printed, external, related).alias("a")).where("part_num <> ''")
    named = F.filter("a", lambda x: (x["number"] != "") & (x["number"] != F.col("part_num")))
    return base.select("part_num", "name", "url", "image_url", _once(named).alias("aliases"))


def _once(aliases: Column, fields: tuple[str, ...] = ("number",)) -> Column:
    """The first alias of each number, or of each combination of fields."""
    same = lambda x, y: reduce(and_, (x[f].eqNullSafe(y[f]) for f in fields))
    seen = lambda acc, x: F.exists(acc, lambda y: same(x, y))
    return F.aggregate(aliases, F.slice(aliases, 1, 0), lambda acc, x: F.when(seen(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def distinct_aliases(aliases: Column) -> Column:
    """Aliases (number, kind, source) once each, the first of equal ones kept, without empty numbers."""
    return _once(F.filter(aliases, lambda x: F.coalesce(x["number"] != "", F.lit(False))), ("number", "kind", "source"))
