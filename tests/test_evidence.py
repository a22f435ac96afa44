"""Colour evidence, rewritten rows, catalog keys and display."""

from pyspark.sql import functions as F

from tallyworks.functions import text as T
from tallyworks.operators import evidence as E


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_color_evidence(spark):
    l = F.lit
    assert one(spark, E.token_evidence(l("Dark Blue brick"), l("Dark Blue")), E.token_evidence(l("dark"), l("Dark Blue")), E.token_evidence(l("trans"), l("Trans Clear")), E.token_evidence(l("x"), l("Red"))) == (72, 44, 12, 0)
    assert one(spark, E.positioned_evidence(l("3001 Red"), l("3001"), l("Red")), E.positioned_evidence(l("Red 3001"), l("3001"), l("Red")), E.positioned_evidence(l("Red"), l("3001"), l("Red"))) == (118, 90, 84)
    assert one(spark, E.color_evidence(l("Red"), l("x"), l("3001"), l(None).cast("string"), l("red"), l(None).cast("string")), E.color_evidence(l(None).cast("string"), l("x"), l("3001"), l("FF0000"), l("Red"), l("#FF0010")), E.context_evidence(l("Red"), l("Red"))) == (90, 82, 54)


def test_rewrite_keys_and_display(spark):
    items = spark.createDataFrame([("m", 1, "4589b", "Red", 2, ["n"]), ("m", 2, "3001", None, None, None), ("m", 3, "77777", "Tan", 1, None)], "manual_id string, sequence int, part_number string, color_name string, quantity int, notes array<string>")
    matches = spark.createDataFrame([("m", 1, 5, "alias"), ("m", 2, 6, "exact")], "manual_id string, sequence int, row int, kind string")
    inventory = spark.createDataFrame([("m", 5, "4589", "Blue", 3), ("m", 6, "3001", "0", 1)], "manual_id string, row int, part_number string, color string, quantity int")
    out = E.rewrite(items, matches, inventory)
    rows = {r.sequence: r for r in out.collect()}
    assert (rows[1].part_number, rows[1].ocr_part_number, rows[1].color_name, rows[1].ocr_color_name, rows[1].status, rows[1].validation_status) == ("4589", "4589b", "Blue", "Red", "complete", "csv-alias-match")
    assert rows[1].notes == ["n", "The inventory suggests 4589 for the part read as 4589b.", "The inventory suggests Blue for the color read as Red.", "The inventory's quantity differs; the manual may be one of several."]
    assert rows[3].notes == ["No row of the inventory matches."] and rows[2].color_id == "0"
    assert rows[2].status == "needs-review" and rows[2].color_name == "Black" and rows[3].validation_status == "csv-no-match"
    assert [r.part_number for r in E.catalog_keys(out, True).collect()] == ["77777"]
    assert {r.part_number for r in E.catalog_keys(out, False).collect()} == {"4589b", "3001", "77777"}
    shown = out.select("*", F.lit(None).cast("string").alias("catalog_part"), F.lit("Qty 4 3001 x").alias("raw_text"), F.lit(None).cast("string").alias("description"))
    assert {(r.sequence, r.quantity, r.part_number) for r in E.displayed(shown).collect()} == {(1, 2, "4589"), (2, 4, "3001")}


def test_candidates_and_requests(spark):
    l = F.lit
    assert one(spark, E.candidate_numbers(l("3001b"), F.array(l("973pr12")), {"3001b": ["3002"]}))[0] == ["3001b", "3001", "3002", "973pr12", "973"]
    assert one(spark, E.safe_request(l("3001pr1"), l(None).cast("string")), E.safe_request(l("../x"), l("1")), E.safe_request(l("3001"), l("red"))) == (True, False, False)


def test_enrich(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    catalog = {"part": frame("part_num string, name string", ("3001", "Brick"), ("9", "Other")), "alias": frame("part string, alias string, kind string", ("4589", "4590", "A"), ("3001", "3002", "M"))}
    out = {r.part_num: (r.name, r.aliases) for r in E.enrich(frame("part_num string, name string", ("3001", None)), frame("part_num string", ("3001",), ("4589b",), ("0",)), catalog).collect()}
    assert out == {"3001": ("Brick", ["3002"]), "4589b": (None, ["4590"])}


def test_colors_count_as_words_by_themselves(spark):
    l = F.lit
    at = lambda text, color, number="3001": one(spark, E.positioned_evidence(l(text), l(number), l(color)))[0]
    assert (at("3001 standard plate", "Tan"), at("3001 Reddish Brown", "Red"), at("Reddish 3001 x red", "Red"), at("13001 red", "Red")) == (0, 0, 117, 84)
    assert (at("3001 trans-clear", "Trans Clear"), at("3001 TransClear", "Trans-Clear"), at("3001 light grey", "Light Gray"), at("3001 transparent red", "Trans Red"), at("3001 (c+) x", "c+")) == (118, 118, 118, 118, 117)
    assert one(spark, E.positioned_evidence(l("3001 x"), l("3001"), l(None).cast("string")), E.positioned_evidence(l("red x"), l(None).cast("string"), l("red"))) == (0, 84)


def test_keys_descriptors_and_elements(spark):
    keys = spark.createDataFrame([], "part_number string")
    rows = spark.createDataFrame([("9", "1"), ("3", "1")], "part_number string, color string")
    assert [r[0] for r in E.fallback_key(keys, rows).collect()] == ["3"] and [r[0] for r in E.fallback_key(rows.where("part_number = '9'"), rows).collect()] == ["9"]
    assert E.fallback_key(keys, rows.where("1 = 0")).collect() == []
    d = spark.createDataFrame([("9", "1", "x")], "part_number string, color string, descriptor string")
    assert {r.part_number: r.descriptor for r in E.with_descriptors(rows, d).collect()} == {"9": "x", "3": None}
    l, nil = F.lit, F.lit(None).cast("string")
    assert one(spark, E.wants_descriptor(l("x"), l("1"), nil, l("csv-no-match")), E.wants_descriptor(l("x"), l("1"), l("2"), nil), E.wants_descriptor(l("x"), l("1"), nil, l("csv-exact-match")), E.wants_descriptor(nil, l("1"), l("2"), nil)) == (True, True, False, False)
    asked = spark.createDataFrame([("1", "5", ["1", "2"])], "part_num string, color_id string, numbers array<string>")
    elements = spark.createDataFrame([("2", "5", ["b", "a"]), ("1", "5", ["c", "b"]), ("1", "6", ["z"])], "part_num string, color_id string, element_ids array<string>")
    assert E.first_elements(asked, elements).first().element_ids == ["c", "b", "a"]
    assert one(spark, E.candidate_numbers(l("24126"), l(None).cast("array<string>")))[0] == ["24126", "2412b", "2412"]


def test_made_up_numbers_have_no_substitutes(spark, tmp_path):
    import duckdb
    from tallyworks.plans import registry

    rows = [(p, s) for p in (14744, 23126, 24375, 91338, 99728, 107721, 42338) for s in (3, 4, 5)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    found = registry.queries()["candidate_number_lists"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(c.execute(registry.oracle_sql()["candidate_number_lists"]).fetchall())


def test_a_name_is_found_by_its_pattern_only_where_its_first_word_is(spark):
    """The check of the first word lets every text pass that the pattern matches."""
    names = ["Sand Green", "grey", "Gray-Blue", "light GREY", "Trans-Clear", "trans", " -x", "Bluish\tGray", "a+b c", " Red ", ""]
    texts = ["2x 3001 sandgreen", "sand-green hook", "gray", "grey", "greyblue", "light gray", "transparent clear", "transclear", "-x", "x", "bluish grey", "a+b c", "red", ""]
    df = spark.createDataFrame([(n, t) for n in names for t in texts], "n string, t string")
    rows = df.select("n", "t", F.regexp_like("t", T.color_pattern(F.col("n"))).alias("hit"), T.may_name(F.col("t"), F.col("n")).alias("may")).collect()
    assert sum(bool(r.hit) for r in rows) >= 10
    assert [r for r in rows if r.hit and not r.may] == []
