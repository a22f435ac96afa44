"""Matching, geometry, bags and windows against plain Python."""

import random

from pyspark.sql import functions as F

from tallyworks.functions import text as T
from tallyworks.operators import bags, geometry, matching, windows


def test_assignment_like_a_loop(spark):
    rng = random.Random(2)
    rows = [(m, s, r, rng.choice(["exact", "alias"]), rng.choice([300, 190, 150]), rng.random() < 0.3, rng.random() < 0.2, rng.randint(0, 8)) for m in "abc" for s in range(8) for r in range(6) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "manual_id string, sequence int, row int, kind string, score int, color_matched boolean, visual_matched boolean, last_exact long")
    expected = set()
    for m in "abc":
        used = set()
        for s in range(8):
            free = sorted((r for r in rows if r[0] == m and r[1] == s and r[2] not in used), key=lambda r: (-r[4], r[2]))
            for gate in (5, 6):
                if any(r[gate] for r in free):
                    free = [r for r in free if r[gate]]
                    break
            best = next((r for r in free if r[3] == "exact" or r[7] <= s), None)
            if best:
                used.add(best[2])
                expected.add(best[:5])
    assert {tuple(r) for r in matching.assign(df).collect()} == expected
    assert matching.assign(df.where("1 = 0")).collect() == []


def test_edges_keep_the_best_evidence(spark):
    items = spark.createDataFrame([("m", 1, "3001"), ("m", 2, "4589b"), ("m", 3, "49661pb01"), ("m", 4, "60481"), ("m", 5, "5555")], "manual_id string, sequence int, part_number string")
    rows = spark.createDataFrame([("m", 1, "3001"), ("m", 2, "4589"), ("m", 3, "49661pr0001"), ("m", 4, "60487"), ("m", 5, "777"), ("n", 6, "3001")], "manual_id string, row int, part_number string")
    aliases = spark.createDataFrame([("777", "5555", "print", "x"), ("3001", "3001", "own", "")], "part string, alias string, kind string, source string")
    found = {(r.sequence, r.row): (r.kind, r.score) for r in matching.edges(items, rows, aliases).collect()}
    assert found == {(1, 1): ("exact", 300), (2, 2): ("alias", 150), (3, 3): ("exact", 260), (4, 4): ("alias", 138), (5, 5): ("alias", 184)}


def test_names_like_all_pairs(spark):
    rng = random.Random(1)
    names = [" ".join(rng.sample(["brick", "plate", "tile", "round", "the", "corner", "slope", "inverted", "with", "pin"], rng.randint(1, 5))) for _ in range(40)]
    stop = {"and", "for", "the", "to", "with", "without"}
    sets = {n: set(n.split()) - stop for n in names}
    expected = {(a, b) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.62}
    df = spark.createDataFrame([(n,) for n in sets], "a string")
    assert {(r.a, r.b) for r in matching.similar_names(df, df.withColumnRenamed("a", "b"), "a", "b").collect()} == expected


def test_text_functions(spark):
    df = spark.createDataFrame([(" × 3001PB01 ﻿", "12abc"), (None, None), ("", "-3")], "a string, b string")
    out = df.select(T.line(F.col("a")), T.canonical_number(T.part_number(F.lit("3001pb01"))), T.leading_integer(F.col("b")), T.half_up(F.lit(-2.5)), T.url_component(F.lit("a b")), T.variant_base(F.lit("3001b")), T.print_base(F.lit("973pr12"))).collect()
    assert tuple(out[0]) == ("x 3001PB01", "3001pr0001", 12, -2, "a%20b", "3001", "973") and out[1][0] is None and out[2][2] is None
    assert [r[0] for r in spark.createDataFrame([("é3001 x 970c12, 123 12345678",)], "a string").select(T.part_numbers(F.col("a"))).collect()] == [["3001", "970c12"]]


def test_points_in_boxes_like_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, rng.randint(0, 40) / 2, rng.randint(0, 40) / 2) for i in range(80)]
    boxes = [(i, x := rng.randint(0, 15), y := rng.randint(0, 15), x + rng.randint(1, 9), y + rng.randint(1, 9)) for i in range(30)]
    expected = {(p[0], b[0]) for p in points for b in boxes if b[1] <= p[1] < b[3] and b[2] <= p[2] < b[4]}
    p = spark.createDataFrame([(1, *x) for x in points], "page int, p int, x double, y double")
    b = spark.createDataFrame([(1, i, float(x), float(y), float(z), float(w)) for i, x, y, z, w in boxes], "page int, b int, x0 double, y0 double, x1 double, y1 double")
    joined = geometry.points_in_boxes(p, b, ["page"], 4.0, 4.0)
    assert sorted((r.p, r.b) for r in joined.collect()) == sorted(expected)


def test_bags_split_no_step_and_keep_all_pieces(spark):
    rng = random.Random(4)
    steps = [(m, s, rng.randint(1, 30), rng.randint(0, 4)) for m in range(20) for s in range(1, 25)]
    out = bags.allocate(spark.createDataFrame(steps, "manual_id int, step int, pieces long, callouts long")).collect()
    assert sorted(tuple(r)[:4] for r in out) == sorted(steps)
    for m in range(20):
        b = [r.bag for r in sorted((r for r in out if r.manual_id == m), key=lambda r: r.step)]
        assert b == sorted(b) and set(b) == set(range(1, b[-1] + 1))
    sizes = {}
    for r in out:
        sizes[r.manual_id, r.bag] = sizes.get((r.manual_id, r.bag), 0) + r.pieces
    assert max(sizes.values()) <= 60


def test_small_manual_is_one_bag(spark):
    out = bags.allocate(spark.createDataFrame([("s", i, 58 // 5 + (i <= 3), 4) for i in range(1, 6)], "manual_id string, step int, pieces long, callouts long")).collect()
    assert {r.bag for r in out} == {1} and sum(r.pieces for r in out) == 58


def test_backward_scan_stops(spark):
    pages = [(p, p in (5, 6, 7)) for p in range(1, 11)]
    df = spark.createDataFrame([("m", *p) for p in pages], "m string, page int, listed boolean")
    assert sorted(r.page for r in windows.backward_stop(df, ["m"], "page", F.col("listed")).collect()) == list(range(3, 11))
