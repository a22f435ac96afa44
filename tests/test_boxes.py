"""Points in boxes over whole tables against a plain loop."""

import random

from tallyworks.operators import geometry
from tallyworks.plans import registry


def test_every_row_is_a_box(spark, tmp_path):
    r = random.Random(3)
    lines = [(o, n, r.randint(1, 900), float(r.randint(1, 50))) for o in range(1, 120) for n in range(1, r.randint(2, 5))]
    events = [(i, r.randint(1, 40), r.choice([5.0, 10.0, r.uniform(0, 60)])) for i in range(600)] + [(700, 3, None), (701, None, 9.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    expected = sorted(
        (o, n, e, o % 7)
        for o, n, part, q in lines
        for e, user, x in events
        if user is not None and x is not None and user % 7 == o % 7 and q <= x < q + 5 and part % 90 <= e % 100 < part % 90 + 8
    )
    found = registry.queries()["point_in_box_whole"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == expected and any(n > 1 for _, n, _, _ in expected)


def test_equal_boxes_meet_a_point_once(spark):
    boxes = spark.createDataFrame([(1, i, 0.0, 0.0, 5.0, 5.0) for i in range(300)] + [(1, 300, 4.0, 4.0, 6.0, 6.0), (2, 301, 0.0, 0.0, 5.0, 5.0), (1, 302, 0.0, None, 5.0, 5.0)], "g int, box int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, "a", 4.5, 4.5), (1, "b", 5.0, 5.0), (2, "c", 5.0, 0.0), (1, "d", -0.0, 0.0), (1, "e", float("nan"), 1.0)], "g int, p string, x double, y double")
    found = geometry.points_in_boxes(points, boxes, ["g"], 4.0, 4.0)
    assert found.columns == ["g", "p", "x", "y", "box", "x0", "y0", "x1", "y1"]
    assert sorted((r.p, r.box, r.x1) for r in found.collect()) == [*(("a", i, 5.0) for i in range(300)), ("a", 300, 6.0), ("b", 300, 6.0), *(("d", i, 5.0) for i in range(300))]
    # what enters the join is the distinct boxes, with lists
    assert "collect_list" in found._jdf.queryExecution().optimizedPlan().toString()


def _nodes(plan):
    """All nodes of a plan that ran."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    yield plan
    for x in below:
        yield from _nodes(x)


def test_lists_of_boxes_are_not_copied(spark):
    places = [(x, y) for x in (0.0, 2.5, 9.0) for y in (1.0, 7.5)]
    boxes = spark.createDataFrame([(1, i, *places[i % 6], places[i % 6][0] + 5, places[i % 6][1] + 8) for i in range(240)], "g int, box int, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    points = spark.createDataFrame([(1, 3.0, 8.0), (1, 9.0, 1.0), (1, 14.0, 1.0)], "g int, x double, y double")
    found = geometry.points_in_boxes(points, boxes, ["g"], 5.0, 8.0)
    assert len(found.collect()) == 5 * 40
    made = [n.metrics().get("numOutputRows").get().value() for n in _nodes(found._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Generate") and "sequence(" in n.simpleString(500)]
    assert made == [6, 6]  # one row for each of the six distinct boxes after the cells of either axis


def test_large_boxes_and_odd_points_meet_once(spark):
    r = random.Random(5)
    inf = float("inf")
    boxes = [(g, i, x := r.randint(-20, 20) / 2, y := r.randint(-20, 20) / 2, x + r.randint(-2, 30) / 2, y + r.randint(0, 30) / 2, r.choice([None, "a", "b"])) for i in range(120) for g in (1, 2)]
    points = [(r.randint(1, 2), i, r.randint(-30, 60) / 2, r.randint(-30, 60) / 2) for i in range(200)] + [(1, 200, -inf, 1.0), (1, 201, 1.0, inf), (2, 202, None, 1.0), (2, 203, inf, -inf)]
    expected = sorted((b[1], b[0], p[1], b[6] or "") for b in boxes for p in points if p[0] == b[0] and p[2] is not None and b[2] <= p[2] < b[4] and b[3] <= p[3] < b[5])
    b = spark.createDataFrame(boxes, "g int, box int, x0 double, y0 double, x1 double, y1 double, note string")
    p = spark.createDataFrame(points, "g int, p int, x double, y double")
    for width, height in ((4.0, 4.0), (1.5, 7.0), (40.0, 0.5)):
        found = geometry.points_in_boxes(p, b, ["g"], width, height)
        assert sorted((x.box, x.g, x.p, x.note or "") for x in found.collect()) == expected
