"""Solids and traced boxes against plain arithmetic."""

import math

from pyspark.sql import functions as F

from tallyworks.operators import geometry, solids

SHAPES = "solid string, nth int, color string, points array<struct<x: double, y: double, z: double>>"


def test_placements_like_numbers(spark):
    a, b = [1.0, 2.0, 0.0, 0.0, 1.0, 3.0, 4.0, 0.0, 1.0], [0.0, 1.0, 0.0, 5.0, 0.0, 1.0, 2.0, 0.0, 1.0]
    times = lambda m, p: [sum(m[3 * r + k] * p[k] for k in range(3)) for r in range(3)]
    m = lambda v: F.array(*map(F.lit, v))
    p = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for c, x in zip("xyz", v)])
    both = solids.joined(m(a), p(1, 2, 3), m(b), p(4, 5, 6))
    row = spark.range(1).select(both.alias("j"), solids.moved(p(7, 8, 9), both["m"], both["shift"]).alias("at")).first()
    inner = [x + s for x, s in zip(times(b, (7, 8, 9)), (4, 5, 6))]
    assert list(row["at"]) == [x + s for x, s in zip(times(a, inner), (1, 2, 3))]


def test_drawing(spark):
    face = lambda z, side=10.0: [(0.0, 0.0, z), (side, 0.0, z), (0.0, side, z)]
    rows = [("a<b", 1, "#FF0000", face(50.0)), ("a<b", 2, None, face(-50.0)), ("a<b", 3, "#4E5459", [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]), ("flat", 1, "none", [(1.0, 1.0, 1.0)] * 3), ("none", 1, "#000000", [])]
    shapes = spark.createDataFrame(rows, SHAPES)
    seen = {(r["solid"], r["nth"]): r for r in solids.projected(shapes, ["solid"], 100).collect()}
    assert set(seen) == {("a<b", 1), ("a<b", 2), ("a<b", 3), ("flat", 1)}
    # the lower face is painted first, the edge last
    assert [seen["a<b", n]["place"] for n in (2, 1, 3)] == [1, 2, 3]
    xs = [p["x"] for k, r in seen.items() if k[0] == "a<b" for p in r["points"]] + [p["y"] for k, r in seen.items() if k[0] == "a<b" for p in r["points"]]
    assert math.isclose(min(xs), 12, abs_tol=1e-9) and math.isclose(max(xs), 88, abs_tol=1e-9)
    assert math.isclose(seen["a<b", 1]["shade"], 0.72 + 0.28 * 0.55 / math.sqrt(0.45**2 + 0.75**2 + 0.55**2))
    assert seen["flat", 1]["shade"] == 0.72 and seen["a<b", 3]["shade"] == 0.82
    svg = {r["solid"]: r["svg"] for r in solids.drawings(shapes, "solid", 100).collect()}
    assert set(svg) == {"a<b", "flat"} and "<title>a&lt;b</title>" in svg["a<b"]
    assert svg["a<b"].count("<polygon") == 2 and svg["a<b"].index("<polygon") < svg["a<b"].index('stroke="#9E0000"') < svg["a<b"].index("<line")
    # a colour that is none becomes the neutral one
    assert 'stroke="#636669"' in svg["flat"]
    assert solids.drawings(shapes.limit(0), "solid", 100).count() == 0


def test_traced(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    region = lambda t, s: {"target": t, "source": s}
    rows = [
        (1, (2.0, 2.0, 4.0, 4.0), [region((0.0, 0.0, 10.0, 10.0), (100.0, 0.0, 120.0, 5.0)), region((0.0, 0.0, 20.0, 20.0), (0.0, 0.0, 1.0, 1.0))]),
        (2, (30.0, 2.0, 34.0, 4.0), [region((0.0, 0.0, 10.0, 10.0), (100.0, 0.0, 120.0, 5.0))]),
        (3, (2.0, 2.0, 4.0, 4.0), []),
        (4, (2.0, 2.0, 4.0, 4.0), None),
        (5, (2.0, 2.0, 2.0, 2.0), [region((2.0, 2.0, 2.5, 2.5), (0.0, 0.0, 8.0, 8.0))]),
    ]
    d = spark.createDataFrame(rows, f"i int, box {box}, regions array<struct<target: {box}, source: {box}>>")
    got = {r["i"]: r["b"] and tuple(r["b"]) for r in d.select("i", geometry.traced(F.col("box"), F.col("regions")).alias("b")).collect()}
    assert got == {1: (104.0, 1.0, 108.0, 2.0), 2: None, 3: (2.0, 2.0, 4.0, 4.0), 4: (2.0, 2.0, 4.0, 4.0), 5: (0.0, 0.0, 0.0, 0.0)}
