"""Solids of polygons and edges: matrices, a fixed view, shading, the fit to a square, painter's order, drawings.

A shape is a row (keys, nth, color, points) with points an array of structs x, y, z: two
points are an edge, more a face. One solid's shapes meet in one partition, as a drawing is
one text; solids are spread by their keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions import text as T

# The turns about y and x in degrees, the light, shades, the margin, the neutral colour.
TURN_Y, TURN_X = -35, -26
LIGHT = (-0.45, -0.75, 0.55)
DARKEST, LIT, FLAT, OUTLINE = 0.72, 0.28, 0.82, 0.62
MARGIN = 0.12
NEUTRAL = "#A0A5A9"


def view(turn_y: float = TURN_Y, turn_x: float = TURN_X) -> list[float]:
    """The matrix, row by row, of a turn about y and then about x."""
    cy, sy, cx, sx = (f(math.radians(a)) for a in (turn_y, turn_x) for f in (math.cos, math.sin))
    return [cy, 0.0, sy, sx * sy, cx, -sx * cy, -cx * sy, sx, cx * cy]


def product(a: Column, b: Column) -> Column:
    """The product of two matrices given as arrays of nine numbers, row by row."""
    return F.array(*[sum((F.get(a, F.lit(3 * r + k)) * F.get(b, F.lit(3 * k + c)) for k in (1, 2)), F.get(a, F.lit(3 * r)) * F.get(b, F.lit(c))) for r in range(3) for c in range(3)])


def moved(p: Column, m: Column, shift: Column | None = None) -> Column:
    """Point p times matrix m, plus the shift if there is one."""
    row = lambda r, c: F.get(m, F.lit(3 * r)) * p["x"] + F.get(m, F.lit(3 * r + 1)) * p["y"] + F.get(m, F.lit(3 * r + 2)) * p["z"] + (shift[c] if shift is not None else F.lit(0.0))
    return F.struct(*[row(r, c).alias(c) for r, c in enumerate("xyz")])


def joined(m: Column, shift: Column, inner: Column, inner_shift: Column) -> Column:
    """Struct m, shift: the inner placement within the outer one."""
    return F.struct(product(m, inner).alias("m"), moved(inner_shift, m, shift).alias("shift"))


def shade(points: Column) -> Column:
    """Brightness of a face by the angle of its first three points to the light; of anything with fewer points a middle one."""
    p = [F.get(points, F.lit(i)) for i in range(3)]
    u, v = ({c: p[i][c] - p[0][c] for c in "xyz"} for i in (1, 2))
    normal = [u[a] * v[b] - u[b] * v[a] for a, b in ("yz", "zx", "xy")]
    length = F.sqrt(sum((n * n for n in normal[1:]), normal[0] * normal[0]))
    unit = math.hypot(*LIGHT)
    toward = F.abs(sum((n * (k / unit) for n, k in zip(normal[1:], LIGHT[1:])), normal[0] * (LIGHT[0] / unit)))
    return F.when(F.size(points) < 3, F.lit(FLAT)).otherwise(DARKEST + LIT * F.when(length > 0, toward / length).otherwise(F.lit(0.0)))


def shaded(color: Column, by: Column | float) -> Column:
    """A hex colour made darker; the neutral one where it is none."""
    rgb = T.rgb(F.coalesce(F.when(T.rgb(color).isNotNull(), color), F.lit(NEUTRAL)))
    channel = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), T.half_up(rgb[c] * by)))), 2, "0")
    return F.concat(F.lit("#"), *[channel(c) for c in "rgb"])


def projected(shapes: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """shapes seen in the fixed view, fitted to a square of ``size`` with margins: points x, y, z (z the depth), depth their mean, shade, and place.

    Faces come before edges, faces from the lowest mean depth on (to nine digits), ties and
    edges by nth. Shapes without points are left out; equal rows get places of their own.
    """
    turned = F.transform("points", lambda p: moved(p, F.array(*[F.lit(v) for v in view()])))
    seen = shapes.where(F.size("points") > 0).withColumn("shade", shade(F.col("points"))).withColumn("points", turned)
    whole = Window.partitionBy(*keys)
    axis = lambda c: F.transform("points", lambda p: p[c])
    bounds = seen.select("*", *[f(g(axis(c))).over(whole).alias(f"_{n}{c}") for c in "xy" for n, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))])
    width, height = (F.greatest(F.col(f"_high{c}") - F.col(f"_low{c}"), F.lit(1.0)) for c in "xy")
    room = size * (1 - 2 * MARGIN)
    scaled = bounds.withColumn("_w", width).withColumn("_h", height).withColumn("_s", F.least(room / F.col("_w"), room / F.col("_h")))
    fit = lambda v, side, low: (v - F.col(low)) * F.col("_s") + (size - F.col(side) * F.col("_s")) / 2
    points = F.transform("points", lambda p: F.struct(fit(p["x"], "_w", "_lowx").alias("x"), fit(p["y"], "_h", "_lowy").alias("y"), p["z"].alias("z")))
    depth = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["z"]) / F.size("points")
    edge = F.size("points") == 2
    order = Window.partitionBy(*keys).orderBy(edge, F.when(~edge, F.round("depth", 9)), "nth")
    fitted = scaled.withColumn("points", points).drop(*[f"_{n}{c}" for c in "xy" for n in ("low", "high")], "_w", "_h", "_s")
    return fitted.withColumn("depth", depth).withColumn("place", F.row_number().over(order))


def _number(v: Column) -> Column:
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.2f", v))


def drawings(shapes: DataFrame, key: str, size: int) -> DataFrame:
    """(key, svg): a drawing of each solid, titled by its key; solids without points have none."""
    p = lambda i, c: _number(F.get("points", F.lit(i))[c])
    face = F.format_string(
        '<polygon points="%s" fill="%s" stroke="%s" stroke-width="1.4" stroke-linejoin="round" />',
        F.array_join(F.transform("points", lambda q: F.concat(_number(q["x"]), F.lit(","), _number(q["y"]))), " "), shaded(F.col("color"), F.col("shade")), shaded(F.col("color"), F.lit(OUTLINE)),
    )
    edge = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="%s" stroke-width="1.2" stroke-linecap="round" />', p(0, "x"), p(0, "y"), p(1, "x"), p(1, "y"), F.col("color"))
    drawn = projected(shapes, [key], size).select(key, F.struct("place", F.when(F.size("points") == 2, edge).otherwise(face).alias("svg")).alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["svg"]), "")
    title = F.replace(F.replace(F.col(key).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}" role="img"><title>'), title, F.lit('</title><rect width="100%" height="100%" fill="none" />'))
    return drawn.groupBy(key).agg(body.alias("_b")).select(key, F.concat(head, F.col("_b"), F.lit("</svg>")).alias("svg"))
