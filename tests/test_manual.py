"""Pages, steps, decisions, exports and freshness of sources."""

from tallyworks.operators import manual as M


def test_pages_steps_and_list(spark):
    text = {1: ["A fine model"], 2: ["Step 1"], 3: ["2", "Qty 1 3001 x"], 4: ["1"], 5: ["Parts", "Qty 2 3001 Black"], 6: [f"{3000 + i} 1x" for i in range(8)], 8: ["Inventory", "3001 2x"]}
    lines = spark.createDataFrame([("m", p, i, t) for p, ts in text.items() for i, t in enumerate(ts)], "manual_id string, page_number int, line_index int, text string")
    pages = M.page_classes(lines)
    assert {r.page_number: r.kind for r in pages.collect()} == {1: "cover", 2: "instruction", 3: "instruction", 4: "instruction", 5: "parts-list", 6: "parts-list", 8: "parts-list"}
    assert [tuple(r) for r in M.list_start(pages).collect()] == [("m", 5, 6)]
    assert {(r.page_number, r.in_order) for r in M.steps(pages).collect()} == {(2, True), (3, True), (4, False)}


def test_callouts_decisions_exports_and_sources(spark, tmp_path):
    c = spark.createDataFrame([("m", 1, 1, 0.0, 0.0), ("m", 1, 2, 9.0, 9.0)], "manual_id string, page_number int, callout int, x double, y double")
    a = spark.createDataFrame([("m", 1, 1, 1.0, 1.0), ("m", 1, 2, 8.0, 8.0)], "manual_id string, page_number int, step int, ax double, ay double")
    assert {(r.callout, r.step) for r in M.callout_steps(c, a).collect()} == {(1, 1), (2, 2)}
    items = spark.createDataFrame([("m", 1, 4), ("m", 2, 5)], "manual_id string, sequence int, quantity int")
    log = spark.createDataFrame([("m", 1, "quantity", "6", 1), ("m", 1, "quantity", "7", 2), ("m", 2, "color", "Red", 3)], "manual_id string, sequence int, field string, after string, at int")
    assert {(r.sequence, r.quantity) for r in M.decided(items, log, "quantity").collect()} == {(1, 7), (2, 5)}
    M.export_bags(items.withColumnRenamed("sequence", "bag"), f"file://{tmp_path}/bags")
    assert spark.read.csv(f"file://{tmp_path}/bags", header=True).count() == 2
    s = spark.createDataFrame([("colors", "e1", 10), ("parts", None, 20)], "source string, etag string, length int")
    assert M.fresh(s, s, ["etag", "length"]) and not M.fresh(s.where("source = 'parts'"), s, ["etag", "length"])
