"""Queries over the driver's tables, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions import shape as S
from tallyworks.functions import text as T
from tallyworks.operators import bags, geometry, matching, relational, windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tallyworks.plans import checks, flagship  # noqa: F401  (checks registers its queries here)

    return _QUERIES | {"part_rows": flagship.part_rows}


def oracle_sql() -> dict[str, str]:
    from tallyworks.plans import checks, flagship  # noqa: F401

    return _SQL | {"part_rows": flagship.PART_ROWS_SQL}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART = r"\b(?:[0-9]{4,7}(?:[A-Za-z][A-Za-z0-9]*)?|[0-9]{3}[A-Za-z][A-Za-z0-9]*)\b"


@query(rf"""
SELECT doc_id, lower(m) AS part_number, count(*)::BIGINT AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PART}')) AS m FROM documents) GROUP BY ALL""")
def token_extract(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(T.part_numbers(F.col("text"))).alias("part_number")).groupBy("doc_id", "part_number").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT p_partkey, l_partkey_text AS part_number, CAST(nullif(regexp_extract(l_partkey_text, '^[0-9]+'), '') AS BIGINT) AS base
FROM (SELECT p_partkey, p_partkey::VARCHAR || 'pr' || p_size::VARCHAR AS l_partkey_text FROM part)""")
def digits_prefix(spark, sf_dir):
    n = F.concat(F.col("p_partkey").cast("string"), F.lit("pr"), F.col("p_size").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", n.alias("part_number")).select("p_partkey", "part_number", T.number_base(F.col("part_number")).cast("long").alias("base"))


@query(r"""
WITH x AS (SELECT p_partkey, p_partkey::VARCHAR || 'pb0' || p_size::VARCHAR AS n FROM part)
SELECT p_partkey, regexp_extract(n, '^([0-9]+)pb0*([0-9]+)$', 1) || 'pr' ||
  CASE WHEN length(regexp_extract(n, '^([0-9]+)pb0*([0-9]+)$', 2)) < 4 THEN lpad(regexp_extract(n, '^([0-9]+)pb0*([0-9]+)$', 2), 4, '0')
       ELSE regexp_extract(n, '^([0-9]+)pb0*([0-9]+)$', 2) END AS canonical FROM x""")
def canonical_code(spark, sf_dir):
    n = F.concat(F.col("p_partkey").cast("string"), F.lit("pb0"), F.col("p_size").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", T.canonical_number(n).alias("canonical"))


@query(r"""
WITH n AS (SELECT DISTINCT p_name FROM part),
w AS (SELECT p_name, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ('and','for','the','to','with','without'))) AS w FROM n)
SELECT a.p_name AS name_a, b.p_name AS name_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS similarity
FROM w a JOIN w b ON a.p_name < b.p_name WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.3""")
def name_jaccard_pairs(spark, sf_dir):
    n = t(spark, sf_dir, "part").select("p_name").distinct()
    pairs = matching.similar_names(n.select(F.col("p_name").alias("name_a")), n.select(F.col("p_name").alias("name_b")), "name_a", "name_b", 0.3)
    return pairs.where("name_a < name_b").select("name_a", "name_b", F.round("similarity", 6).alias("similarity"))


@query(r"""
WITH p AS (SELECT lpad(p_partkey::VARCHAR, 6, '0') AS n FROM part)
SELECT a.n AS a, b.n AS b, 138 AS score FROM p a JOIN p b ON a.n < b.n WHERE hamming(a.n, b.n) = 1""")
def hamming1_pairs(spark, sf_dir):
    n = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    p = t(spark, sf_dir, "part")
    return matching.near_numbers(p.select(n.alias("a")), p.select(n.alias("b")), "a", "b").where("a < b")


_PAIRS = "SELECT l_partkey AS child, l_suppkey AS parent, CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'R' THEN 'M' ELSE 'P' END AS kind, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem"


def _ordered_lines(spark, sf_dir):
    """lineitem with a total order, as a sortable struct: no global row number is needed."""
    return t(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query(f"""
WITH p AS ({_PAIRS}), u AS (SELECT child AS part, parent AS alias, kind, o FROM p UNION ALL SELECT parent, child, kind, o FROM p WHERE kind IN ('A', 'M'))
SELECT part, alias, arg_min(kind, o) AS kind FROM u WHERE part <> alias GROUP BY part, alias""")
def alias_index(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "M").otherwise("P")
    return relational.alias_lists(_ordered_lines(spark, sf_dir).select(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent"), kind.alias("kind"), "o"), "o")


@query("""
WITH x AS (SELECT l_partkey, l_returnflag, l_suppkey, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS o FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_returnflag, string_agg(l_suppkey::VARCHAR, ',' ORDER BY o) AS elements FROM x GROUP BY ALL""")
def element_lists(spark, sf_dir):
    lists = relational.ordered_lists(_ordered_lines(spark, sf_dir), ["l_partkey", "l_returnflag"], "l_suppkey", "o", "e")
    return lists.select("l_partkey", "l_returnflag", F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("elements"))


@query("""
SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
FROM orders GROUP BY o_custkey""")
def last_writer_dim(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("o", F.struct("o_orderdate", "o_orderkey"))
    return relational.last_writer(o, ["o_custkey"], ["o_orderstatus", "o_totalprice"], "o")


@query("""
SELECT user_id, arg_min(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value, arg_min(p, (ts, event_id)) FILTER (WHERE p IS NOT NULL) AS props
FROM (SELECT *, CASE WHEN event_type = 'click' THEN props END AS p FROM events) GROUP BY user_id""")
def first_non_null_merge(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "value", F.when(F.col("event_type") == "click", F.col("props")).alias("props"), F.struct("ts", "event_id").alias("o"))
    return relational.first_known(e, ["user_id"], ["value", "props"], "o")


@query("""
WITH e AS (SELECT p_partkey AS k, p_name AS v, 0 AS p, -p_partkey AS o FROM part WHERE p_size <= 25),
a AS (SELECT l_partkey AS k, 'alias of ' || min(l_suppkey)::VARCHAR AS v, 1 AS p, l_partkey AS o FROM lineitem GROUP BY l_partkey)
SELECT k, arg_min(v, (p, o)) AS v FROM (SELECT * FROM e UNION ALL SELECT * FROM a) GROUP BY k""")
def catalog_precedence_join(spark, sf_dir):
    exact = t(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"), F.col("p_partkey").alias("o"))
    alias = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_suppkey").alias("s")).select("k", F.concat(F.lit("alias of "), F.col("s").cast("string")).alias("v"), F.col("k").alias("o"))
    return relational.keyed_lookup(exact, alias, "k", "v", "o")


@query("""
SELECT c_custkey, lower(n_name) AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dim_left_join(spark, sf_dir):
    c, n, r = (t(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", F.lower("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def missing_keys(spark, sf_dir):
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def selected_semi(spark, sf_dir):
    return t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem").where("l_quantity >= 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""
WITH g AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1)
SELECT p_partkey, p_name FROM part SEMI JOIN g ON p_partkey = l_partkey""")
def multi_candidate_gate(spark, sf_dir):
    g = relational.choices(t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")
    return t(spark, sf_dir, "part").join(g, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, (CASE WHEN l_returnflag = 'R' THEN 300 ELSE 100 END + (l_quantity % 7)::INT)::BIGINT AS score, (l_orderkey, l_linenumber) AS o FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY score DESC, o, l_suppkey))
SELECT l_partkey, l_suppkey, score FROM r WHERE n = 1 AND (score >= 300 OR nxt IS NULL OR nxt < score)""")
def ranked_match_no_ties(spark, sf_dir):
    score = (F.when(F.col("l_returnflag") == "R", 300).otherwise(100) + (F.col("l_quantity") % 7).cast("int")).cast("long")
    s = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", score.alias("score"), F.struct("l_orderkey", "l_linenumber").alias("o"))
    return windows.unambiguous_best(s, ["l_partkey"], "score", ["o", "l_suppkey"], F.col("score") >= 300).select("l_partkey", "l_suppkey", "score")


@query()
def greedy_assignment(spark, sf_dir):
    """Lines of a customer's orders as items, the parts of the same size as inventory rows: one row an item at most."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("manual_id"))
    lines = t(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    items = windows.renumber(lines.select("manual_id", F.lpad(F.col("l_partkey").cast("string"), 5, "0").alias("part_number"), "l_orderkey", "l_linenumber", "l_suppkey"), ["manual_id"], ["l_orderkey", "l_linenumber", "l_suppkey", "part_number"]).withColumn("sequence", F.col("sequence").cast("long"))
    rows = lines.groupBy("manual_id", (F.col("l_partkey") + F.pmod(F.col("l_suppkey"), F.lit(2))).alias("k")).agg(F.min("l_orderkey").alias("x"))
    inventory = windows.renumber(rows.select("manual_id", F.lpad(F.col("k").cast("string"), 5, "0").alias("part_number")), ["manual_id"], ["part_number"], "row").withColumn("row", F.col("row").cast("long"))
    scored = matching.edges(items, inventory).join(matching.future_exact(items, inventory), ["manual_id", "row"], "left")
    return matching.assign(scored)


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
m AS (SELECT user_id, event_type, max(s) AS last FROM e GROUP BY ALL)
SELECT event_id, (last > s) AS later FROM e JOIN m USING (user_id, event_type)""")
def future_exists(spark, sf_dir):
    e = windows.renumber(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "s")
    last = e.groupBy("user_id", "event_type").agg(F.max("s").alias("last"))
    return e.join(last, ["user_id", "event_type"]).select("event_id", (F.col("last") > F.col("s")).alias("later"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS after FROM e""")
def context_asof(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return windows.nearest_known(e, ["user_id"], "v", ["ts", "event_id"]).select("event_id", "before", "after")


@query("""
WITH e AS (SELECT user_id, event_id, ts, (event_type = 'error')::INT AS m, (event_type = 'click') AS b FROM events),
n AS (SELECT *, sum(m) OVER w AS frame, lead(m) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_id, frame::BIGINT AS frame, row_number() OVER (PARTITION BY user_id, frame ORDER BY ts, event_id) AS place FROM n WHERE frame > 0
      UNION ALL SELECT user_id, event_id, (frame + 1)::BIGINT, 0 FROM n WHERE m = 0 AND nxt = 1 AND b),
h AS (SELECT *, min(place) OVER (PARTITION BY user_id, frame) AS has FROM i)
SELECT user_id, frame, event_id, place::INT AS place FROM h WHERE place <= CASE WHEN has = 0 THEN 4 ELSE 5 END""")
def context_frame(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return windows.frames(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "click").select("user_id", "frame", "event_id", F.col("place").cast("int").alias("place"))


_HOURS = "SELECT user_id % 5 AS g, (floor(epoch(ts))::BIGINT // 3600) AS h, count(*) AS n FROM events GROUP BY ALL"


def _hours(spark, sf_dir):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return t(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(5)).alias("g"), hour.alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH p AS ({_HOURS}), d AS (SELECT *, h - row_number() OVER (PARTITION BY g ORDER BY h) AS i FROM p WHERE n >= 4),
isl AS (SELECT g, i, min(h) AS lo, max(h) AS hi FROM d GROUP BY ALL), l AS (SELECT g, max(hi) AS hi, arg_max(lo, hi) AS lo FROM isl GROUP BY g),
r AS (SELECT p.*, lo, hi, h - row_number() OVER (PARTITION BY p.g ORDER BY h) AS run FROM p LEFT JOIN l USING (g)),
a AS (SELECT *, max(CASE WHEN h = hi THEN run END) OVER (PARTITION BY g) AS anchor FROM r)
SELECT g, h, n FROM a WHERE hi IS NULL OR h BETWEEN lo AND hi OR (h > hi AND run = anchor)""")
def trailing_island(spark, sf_dir):
    return windows.trailing_island(_hours(spark, sf_dir), ["g"], "h", F.col("n") >= 4).select("g", "h", "n")


@query(f"""
WITH p AS (SELECT *, (n >= 4)::INT AS l FROM ({_HOURS})),
a AS (SELECT *, row_number() OVER w AS k, max(l) OVER (w ROWS UNBOUNDED PRECEDING) AS found, sum(l) OVER (w ROWS UNBOUNDED PRECEDING) AS grp FROM p WINDOW w AS (PARTITION BY g ORDER BY h DESC)),
b AS (SELECT *, sum(1 - l) OVER (PARTITION BY g, grp ORDER BY h DESC ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, min(CASE WHEN found = 1 AND run >= 2 THEN k END) OVER (PARTITION BY g) AS cut FROM b)
SELECT g, h, n FROM c WHERE k <= coalesce(cut, 64) AND k <= 64""")
def backward_stop(spark, sf_dir):
    return windows.backward_stop(_hours(spark, sf_dir), ["g"], "h", F.col("n") >= 4).select("g", "h", "n")


@query("""
WITH e AS (SELECT event_id, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT event_id, round(coalesce((p + value) / 2, value - 0.5::DOUBLE * (n - value), value), 6) AS low, round(coalesce((value + n) / 2, value + 0.5::DOUBLE * (value - p), value), 6) AS high FROM e""")
def midpoint_bounds(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return windows.midpoints(e, ["user_id"], "value", ["value", "event_id"]).select("event_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""
WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 36000 THEN 1 ELSE 0 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS band FROM f)
SELECT user_id, band::BIGINT AS band, min(s) AS first, max(s) AS last, count(*)::BIGINT AS n FROM b GROUP BY user_id, band HAVING count(*) >= 2""")
def band_merge(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return windows.bands(e, ["user_id"], "s", 36000, 2)


@query()
def point_in_box_whole(spark, sf_dir):
    """Every lineitem row as a box; no SQL, as DuckDB would compare all pairs of a group."""
    p = t(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(7)).alias("g"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    b = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("box"), F.col("l_linenumber").alias("line"), F.pmod("l_orderkey", F.lit(7)).alias("g"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_partkey") % 90).cast("double").alias("y0"), (F.col("l_partkey") % 90 + 8).cast("double").alias("y1"))
    return geometry.points_in_boxes(p, b, ["g"], 5.0, 8.0).select("box", "line", "event_id", "g")


@query("""
WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
d AS (SELECT a.label, a.vec_id AS q, b.vec_id AS p, round(0.7::DOUBLE * abs(a.x - b.x) + abs(a.y - b.y), 9) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label, q, arg_min(p, (d, p)) AS p FROM d GROUP BY label, q""")
def nearest_neighbour(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    a, b = v.select("label", F.col("vec_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy")), v.select("label", F.col("vec_id").alias("p"), "x", "y")
    d = F.when(F.col("q") != F.col("p"), F.round(0.7 * F.abs(F.col("qx") - F.col("x")) + F.abs(F.col("qy") - F.col("y")), 9)).otherwise(F.lit(float("inf")))
    return geometry.nearest(a, b, ["label"], "q", "p", d).select("label", "q", "p")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS e FROM embeddings), h AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS h FROM v)
SELECT a.vec_id, round(greatest(0, least(1, 1 - list_sum(list_transform(list_zip(a.h, b.h), lambda z: abs(z[1] - z[2]))) / 2)), 6) AS likeness FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""")
def histogram_similarity(spark, sf_dir):
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    h = t(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).select("vec_id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, v: s + v)).alias("h"))
    b = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return h.join(b, "vec_id").select("vec_id", F.round(S.histogram_likeness(F.col("h"), F.col("g")), 6).alias("likeness"))


@query("""
WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY event_type),
c AS (SELECT e.event_type, greatest(0, least(7, floor((value - lo) / greatest(hi - lo, 1e-9) * 8)::INT)) AS bin, count(*) AS c FROM events e JOIN r USING (event_type) GROUP BY ALL)
SELECT r.event_type, b.bin::INT AS bin, round(coalesce(c, 0) / n::DOUBLE, 9) AS share FROM r CROSS JOIN (SELECT unnest(range(8)) AS bin) b LEFT JOIN c ON c.event_type = r.event_type AND c.bin = b.bin""")
def norm_histogram8(spark, sf_dir):
    return S.histogram(t(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "bin", F.round("share", 9).alias("share"))


@query("""
WITH c AS (SELECT l_returnflag, l_linestatus, floor(l_extendedprice / 1000)::BIGINT AS bucket, count(*) AS n, avg(1 + l_discount) AS w FROM lineitem GROUP BY ALL HAVING count(*) >= 8)
SELECT l_returnflag, l_linestatus, arg_max(bucket, (round(n * w, 6), -bucket)) AS bucket FROM c GROUP BY ALL""")
def dominant_bucket(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    c = l.groupBy("l_returnflag", "l_linestatus", F.floor(F.col("l_extendedprice") / 1000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(1 + F.col("l_discount")).alias("w")).where("n >= 8")
    return c.groupBy("l_returnflag", "l_linestatus").agg(F.max_by("bucket", F.struct(F.round(F.col("n") * F.col("w"), 6), -F.col("bucket"))).alias("bucket"))


@query("SELECT user_id, min(value) AS x0, max(value) AS x1, min(event_id) AS y0, max(event_id) AS y1, count(*)::BIGINT AS n FROM events GROUP BY user_id HAVING count(*) >= 18")
def bounding_box(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("x0"), F.max("value").alias("x1"), F.min("event_id").alias("y0"), F.max("event_id").alias("y1"), F.count(F.lit(1)).alias("n")).where("n >= 18")


@query("SELECT conv_id, string_agg(role || ': ' || text, ' ' ORDER BY turn, role, text) AS line, count(*)::BIGINT AS n, floor(avg(length(text)) + 0.5)::BIGINT AS mean_chars FROM conversations GROUP BY conv_id")
def line_assembly(spark, sf_dir):
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(parts, " ").alias("line"), F.count(F.lit(1)).alias("n"), T.half_up(F.avg(F.length("text"))).alias("mean_chars"))


@query("SELECT lang, round(avg(quality), 9) AS mean_quality, count(quality)::BIGINT AS n_known, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def mean_ignore_null(spark, sf_dir):
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left").groupBy("lang").agg(F.round(F.avg("quality"), 9).alias("mean_quality"), F.count("quality").alias("n_known"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY l_orderkey")
def unique_value_repair(spark, sf_dir):
    return relational.only_value(t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag").select("l_orderkey", F.col("l_returnflag").alias("flag"))


@query("""
SELECT sum(l_quantity)::BIGINT AS total, (SELECT sum(q)::BIGINT FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)) AS by_order,
  (SELECT sum(q)::BIGINT FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey, l_suppkey)) AS by_part FROM lineitem""")
def conservation_totals(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    total = lambda name, *k: (l.groupBy(*k).agg(F.sum("l_quantity").alias("q")) if k else l.select(F.col("l_quantity").alias("q"))).agg(F.sum("q").cast("long").alias("v")).select(F.lit(name).alias("name"), "v")
    rows = total("total").unionByName(total("by_order", "l_orderkey")).unionByName(total("by_part", "l_partkey", "l_suppkey"))
    return rows.groupBy().pivot("name", ["total", "by_order", "by_part"]).agg(F.first("v"))


@query(f"""
WITH RECURSIVE s AS (SELECT l_orderkey AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS step, l_quantity::BIGINT AS pieces, 1::BIGINT AS callouts FROM lineitem),
f AS (SELECT m, step, pieces, callouts, 1 AS bag, pieces AS p, callouts AS c FROM s WHERE step = 1
  UNION ALL SELECT m, step, pieces, callouts, CASE WHEN new THEN bag + 1 ELSE bag END, CASE WHEN new THEN pieces ELSE p + pieces END, CASE WHEN new THEN callouts ELSE c + callouts END
  FROM (SELECT s.m, s.step, s.pieces, s.callouts, f.bag, f.p, f.c, f.p > 0 AND (f.p + s.pieces > 60 OR f.c + s.callouts > 35 OR f.p + s.pieces + 1.25 * (f.c + s.callouts) > 95
    OR (f.p >= 40 AND (f.c + s.callouts > 28 OR f.p + s.pieces + 1.25 * (f.c + s.callouts) > 80 OR abs(f.p + s.pieces - 50) > abs(f.p - 50)))) AS new FROM f JOIN s ON s.m = f.m AND s.step = f.step + 1)),
g AS (SELECT m, bag, sum(pieces) AS p, sum(callouts) AS c FROM f GROUP BY ALL), l AS (SELECT m, max(bag) AS b FROM g GROUP BY m),
j AS (SELECT l.m, l.b FROM l JOIN g x ON x.m = l.m AND x.bag = l.b JOIN g y ON y.m = l.m AND y.bag = l.b - 1 WHERE x.p < 40 AND x.p + y.p <= 60 AND x.c + y.c <= 35 AND x.p + y.p + 1.25 * (x.c + y.c) <= 95)
SELECT f.m AS manual_id, f.step::BIGINT AS step, f.pieces::BIGINT AS pieces, f.callouts::BIGINT AS callouts, CASE WHEN j.b IS NOT NULL AND f.bag = j.b THEN f.bag - 1 ELSE f.bag END::INT AS bag FROM f LEFT JOIN j ON j.m = f.m""")
def bag_allocation(spark, sf_dir):
    l = windows.renumber(t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "step")
    return bags.allocate(l.select(F.col("l_orderkey").alias("manual_id"), F.col("step").cast("long").alias("step"), F.col("l_quantity").cast("long").alias("pieces"), F.lit(1).cast("long").alias("callouts")))


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type)
SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90
FROM events JOIN q USING (event_type) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY event_type""")
def iqr_trim(spark, sf_dir):
    kept = bags.inside_fences(t(spark, sf_dir, "events"), "value", ["event_type"])
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query(r"""
SELECT w, count(*)::BIGINT AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY w ORDER BY n DESC, length(w) DESC, w LIMIT 50""")
def tokens_topk(spark, sf_dir):
    """The 50 most frequent words: the limit is the query."""
    w = t(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 4)
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc(F.length("w")), "w").limit(50)


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_strip_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \t\r\n]+", " ")).alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, max(value) AS top FROM events GROUP BY event_type HAVING count(*) >= 8")
def page_summary(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.max("value").alias("top")).where("n >= 8")


@query(r"""
SELECT part, alias, min(kind) AS kind FROM (
  SELECT c.p_partkey AS part, a.l_suppkey AS alias, a.l_returnflag AS kind FROM (SELECT p_partkey, p_partkey AS root FROM part UNION SELECT p_partkey, p_partkey // 10 FROM part) c
  JOIN (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) a ON a.l_partkey = c.root) WHERE alias <> part GROUP BY ALL""")
def alias_expansion(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    aliases = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("alias"), F.col("l_returnflag").alias("kind")).distinct()
    return relational.expand_roots(p, [F.col("part"), F.floor(F.col("part") / 10)], aliases)


@query("SELECT p_partkey, concat('/image/', replace(p_name, ' ', '%20'), '?color=', p_size::VARCHAR) AS url FROM part")
def image_urls(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/image/"), T.url_component(F.col("p_name")), F.lit("?color="), F.col("p_size").cast("string")).alias("url"))


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS sequence, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events WHERE value > 20""")
def renumber_and_pairs(spark, sf_dir):
    e = windows.renumber(t(spark, sf_dir, "events").where("value > 20"), ["user_id"], ["ts", "event_id"])
    return e.select("user_id", "event_id", "sequence", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_type"))


@query("""
WITH v AS (SELECT p_brand AS k, 0 AS p, p_partkey AS o, p_type AS v FROM part WHERE p_size > 30 UNION ALL SELECT p_brand, 1, p_partkey, 'default' FROM part)
SELECT k, arg_min(v, (p, o)) AS v FROM v GROUP BY k""")
def vocabulary_union(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    a = p.where("p_size > 30").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("o"), F.col("p_type").alias("v"))
    b = p.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("o"), F.lit("default").alias("v"))
    return relational.union_first([a, b], ["k"], "o").select("k", "v")


@query("""
WITH c AS (SELECT p_partkey, p_size * 5 % 256 AS r, p_partkey % 256 AS g, (p_partkey * 7) % 256 AS b FROM part)
SELECT x.p_partkey, round(sqrt((x.r - y.r)^2 + (x.g - y.g)^2 + (x.b - y.b)^2), 6) AS distance,
  CASE WHEN sqrt((x.r - y.r)^2 + (x.g - y.g)^2 + (x.b - y.b)^2) <= 32 THEN 82 WHEN sqrt((x.r - y.r)^2 + (x.g - y.g)^2 + (x.b - y.b)^2) <= 58 THEN 68 WHEN sqrt((x.r - y.r)^2 + (x.g - y.g)^2 + (x.b - y.b)^2) <= 86 THEN 40 WHEN sqrt((x.r - y.r)^2 + (x.g - y.g)^2 + (x.b - y.b)^2) <= 116 THEN 24 ELSE 0 END AS score
FROM c x JOIN c y ON y.p_partkey = x.p_partkey + 1""")
def color_tiers(spark, sf_dir):
    hexed = F.concat(*[F.lpad(F.hex(v), 2, "0") for v in (F.col("p_size") * 5 % 256, F.col("p_partkey") % 256, F.col("p_partkey") * 7 % 256)])
    c = t(spark, sf_dir, "part").select("p_partkey", T.rgb(hexed).alias("c"))
    y = c.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("c").alias("d"))
    d = T.color_distance(F.col("c"), F.col("d"))
    return c.join(y, "p_partkey").select("p_partkey", F.round(d, 6).alias("distance"), matching.tier(d, matching.COLOR_TIERS, True).alias("score"))
