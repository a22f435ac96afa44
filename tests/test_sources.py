"""Readers, the published catalog, project documents, images and the stream."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.operators import images
from tallyworks.sources import catalog, csv, ocr, projects
from tallyworks.streaming import manuals


def test_cells_keep_quotes_line_ends_and_blank_rows_inside():
    assert csv.cells('a,"b ""x"", c"\r\n\n1,"two\nlines"\n') == [["a", 'b "x", c'], [""], ["1", "two\nlines"]]
    assert csv.cells("") == []


def test_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Part,Color,Quantity,Is Spare\n3001,5,4,True\n\n3002 ,,2,False\n3003,1,4x,no\n3004,1,0,\n")
    (tmp_path / "b.csv").write_text("Name,Color\nx,1\n")
    (tmp_path / "c.csv").write_text("part,color,qty\n")
    items, warnings = csv.inventory(spark, f"file://{tmp_path}/*.csv")
    assert [(r.line, r.part, r.color, r.quantity, r.spare) for r in items.orderBy("line").collect()] == [(2, "3001", "5", 4, True), (5, "3003", "1", 4, False)]
    assert sorted((r.file[-5:], r.line) for r in warnings.collect()) == [("a.csv", 4), ("a.csv", 6), ("b.csv", 0), ("c.csv", 0)]


def test_words_and_lines(spark, tmp_path):
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\t1\t1\t1\t2\t30\t10\t20\t8\t90.5\tb\tc", "5\t1\t1\t1\t1\t1\t10\t12\t15\t8\t-1\ta", "5\t1\t1\t1\t2\t1\tx\t12\t15\t8\t50\tbad", "5\t1\t1\t1\t3\t1\t\t1\t2\t3\t50\t "]
    (tmp_path / "p.tsv").write_text("\n".join(rows))
    w = ocr.words(spark, f"file://{tmp_path}/p.tsv")
    assert sorted((r.text, r.confidence, r.x0, r.y1) for r in w.collect()) == [("a", None, 10.0, 20.0), ("b\tc", 91, 30.0, 18.0)]
    line = ocr.lines(w, ["page_num"]).first()
    assert (line.text, line.confidence, line.x0, line.y0, line.x1, line.y1) == ("a b\tc", 91, 10.0, 10.0, 50.0, 20.0)


def test_pdf_signature(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 100 + b"%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"x" * 2000 + b"%PDF-1.7")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.7")
    assert [r.path[-5:] for r in ocr.documents(spark, f"file://{tmp_path}").collect()] == ["a.pdf"]


def bulk_files(folder):
    files = {
        "colors": "id,name,rgb\n1,Blue,0000FF\n1,Bluish,\n2,Red,FF0000\n",
        "parts": 'part_num,name\n3001,Brick\n3001,Brick 2 x 4\n3002A,"Plate\n1 x 2"\n',
        "elements": "element_id,part_num,color_id\n9,3001,1\n7,3001,1\n9,3001,1\n8,3002A,2\n",
        "part_relationships": "rel_type,child_part_num,parent_part_num\nA,3001,3002A\nP,3005,3001\nM,3001,3002A\nX,1,2\nA,3001,3001\n",
    }
    for n, t in files.items():
        (folder / f"{n}.csv.gz").write_bytes(gzip.compress(t.encode()))


def test_catalog_is_built_published_and_looked_up(spark, tmp_path):
    bulk_files(tmp_path)
    built = catalog.build(spark, f"file://{tmp_path}")
    root = f"file://{tmp_path}/index"
    assert catalog.load(spark, root) is None
    catalog.publish(spark, built, root)
    catalog.publish(spark, built, root)
    c = catalog.load(spark, root)
    assert {r.id: (r.name, r.rgb) for r in c["color"].collect()} == {"1": ("Bluish", "0000FF"), "2": ("Red", "FF0000")}
    assert {r.part_num: r.name for r in c["part"].collect()} == {"3001": "Brick 2 x 4", "3002a": "Plate\n1 x 2"}
    assert {(r.part_num, r.color_id): r.element_ids for r in c["element"].collect()} == {("3001", "1"): ["9", "7"], ("3002a", "2"): ["8"]}
    assert {(r.part, r.alias, r.source) for r in c["alias"].collect() if r.kind == "relationship"} == {("3001", "3002a", "A"), ("3002a", "3001", "A"), ("3005", "3001", "P")}
    parts, missing = catalog.lookup(c, spark.createDataFrame([(" 3001",), ("3005",), ("77",), ("",)], "part_num string"))
    assert [r.part_num for r in parts.collect()] == ["3001"] and [r.part_num for r in missing.collect()] == ["77"]
    with pytest.raises(ValueError, match="at most"):
        catalog.lookup(c, spark.range(1001).select(F.col("id").cast("string").alias("part_num")))


def test_payloads(spark):
    one = {"part_num": "3001A", "name": "Brick", "print_of": "3001", "external_ids": {"x": ["9", "3001"], "y": {"ext_ids": ["8"]}, "z": "7"}, "relationships": [{"rel_type": "M", "child_part_num": "5"}]}
    rows = [(json.dumps({"results": [one, {"name": "no number"}]}),), (json.dumps([{"part_num": "1"}]),), (json.dumps({"part_num": "2"}),), ("not json",), (None,)]
    out = {r.part_num: r for r in catalog.payload_parts(spark.createDataFrame(rows, "payload string")).collect()}
    assert set(out) == {"3001a", "1", "2"}
    assert {(a.number, a.kind) for a in out["3001a"].aliases} == {("3001", "print"), ("9", "external"), ("8", "external"), ("7", "external"), ("5", "relationship")}


def test_projects(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    make = lambda *rows: spark.createDataFrame(rows, "project_id string, name string")
    projects.save(make(("a", "1"), ("b", "1")), root)
    projects.save(make(("a", "2")), root)
    assert projects.load(spark, root, "a").first().name == "2" and projects.load(spark, root, "b").first().name == "1"
    assert projects.delete(spark, root, "b") and not projects.delete(spark, root, "b")
    for name in ("rawText", "ocr_text", "textLines", "Crops", "manualBytes"):
        with pytest.raises(ValueError, match=rf"\$\.{name}"):
            projects.save(spark.createDataFrame([], f"project_id string, {name} string"), root)
    empty = projects.empty(make(("a", "1"), ("b", "2")))
    r = empty.first()
    assert r.schema_version == 1 and r.manual is None and r.bag_splits == [] and r.updated_at is not None
    meta = spark.createDataFrame([("a", "m.pdf", 5, "application/pdf", 7, 3, "secret")], "project_id string, file_name string, file_size long, file_type string, last_modified long, page_count int, text string")
    both = {x.project_id: x.manual for x in projects.with_manual(empty, meta).collect()}
    assert both["b"] is None and both["a"].asDict() == {"file_name": "m.pdf", "file_size": 5, "file_type": "application/pdf", "last_modified": 7, "page_count": 3}
    with pytest.raises(ValueError, match=r"\$\.doc\.pdf_bytes, \$\.raw"):
        projects.save(spark.createDataFrame([], "project_id string, doc struct<pdf_bytes: string>, raw binary"), root)


def test_images(spark):
    page = np.full((60, 80, 3), 255, np.uint8)
    page[10:30, 10:30] = (200, 0, 0)
    page[10:30, 50:70] = (0, 0, 120)
    rows = [("m", 1, 80, 60, bytearray(page.tobytes()))]
    out = images.cards(spark.createDataFrame(rows, "manual_id string, page_number int, width int, height int, pixels binary")).orderBy("card_index").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.rgb) for r in out] == [(10, 10, 30, 30, "c80000"), (50, 10, 70, 30, "000078")]
    d = images.descriptor(page[:, :40])
    assert d["aspect_ratio"] == 1 and d["fill_ratio"] == 1 and sum(d["x_hist"]) == pytest.approx(1)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"manual_id": "m", "page_number": 1, "line_index": i, "text": t, "confidence": 90.0} for i, t in enumerate(["Parts", "Qty 2 3020 Black Plate"])]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    q = manuals.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert [(r.part_number, r.quantity) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [("3020", 2)]


def test_nested_pages(spark):
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), v))
    word = {"text": "3001", "confidence": 91, "bbox": box(1, 2, 3, 4)}
    blocks = [{"paragraphs": None}, {"paragraphs": [{"lines": [{"text": "2x 3001", "bbox": box(0, 0, 9, 9), "words": [word, {"text": " ", "bbox": box(0, 0, 1, 1)}, {"text": "x"}]}, {"text": "  "}]}, {}]}]
    pages = [(1, {"blocks": blocks, "text": "other"}), (2, {"blocks": [], "text": "a\r\n\n b", "confidence": 7}), (3, {"blocks": [{"paragraphs": [{"lines": [{"text": " "}]}]}], "text": "hidden"}), (4, {})]
    d = spark.createDataFrame([(n, json.dumps(p)) for n, p in pages] + [(5, "no json"), (6, None)], "page_number int, data string")
    assert [tuple(r) for r in ocr.nested_words(d).collect()] == [(1, 0, "3001", 91.0, 1.0, 2.0, 3.0, 4.0)]
    got = sorted((r["page_number"], r["text"], r["confidence"], r["x1"]) for r in ocr.nested_lines(d).collect())
    assert got == [(1, "2x 3001", None, 9.0), (2, " b", 7.0, None), (2, "a", 7.0, None)]
    b = "struct<x0: double, y0: double, x1: double, y1: double>"
    regions = spark.createDataFrame([(1, [{"target": box(0.0, 0.0, 3.0, 4.0), "source": box(10.0, 10.0, 16.0, 14.0)}])], f"page_number int, regions array<struct<target: {b}, source: {b}>>")
    placed = d.join(regions, "page_number")
    assert [tuple(r)[4:] for r in ocr.nested_words(placed).collect()] == [(12.0, 12.0, 16.0, 14.0)]
    # the line's centre lies in no region: it stays without a box
    assert [(r["text"], r["x0"]) for r in ocr.nested_lines(placed).collect()] == [("2x 3001", None)]
