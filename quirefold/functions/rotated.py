"""Least rectangles of contours (G7) and rows of grown convex polygons (A18), as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def hull(points: Column) -> Column:
    """The corners of the convex hull of an array of points, counter-clockwise in x right, y up.

    Points in order of x, then y, go on a chain, from whose end those are taken first that
    would not turn left; once for the lower and once for the upper chain. Points on an edge
    are no corners; fewer than three distinct points are their own hull.
    """
    plain = F.array_sort(F.array_distinct(F.transform(points, lambda p: _point(p["x"], p["y"]))))

    def chain(ordered: Column) -> Column:
        def add(state: Column, p: Column) -> Column:
            turns = F.filter(
                F.sequence(F.lit(2), F.greatest(F.size(state), F.lit(2))),
                lambda i: F.coalesce(_cross(F.get(state, i - 2), F.get(state, i - 1), p) > 0, F.lit(False)),
            )
            kept = F.coalesce(F.array_max(turns), F.lit(1))
            return F.concat(F.slice(state, F.lit(1), kept), F.array(p))

        return F.aggregate(ordered, F.array().cast("array<struct<x:double,y:double>>"), add)

    def both(p: Column) -> Column:
        low, high = chain(p), chain(F.reverse(p))
        but_last = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
        return F.when(F.size(p) < 3, p).otherwise(F.concat(but_last(low), but_last(high)))

    return _let(plain, both)


def least_rectangle(points: Column) -> Column:
    """struct(``short``, ``long``, ``ux``, ``uy``, ``a0``, ``a1``, ``b0``, ``b1``): the rectangle of least area about the points.

    One side lies along an edge of the hull, the unit vector u; a0 to a1 is its extent along u
    and b0 to b1 across. Of rectangles of one area (to six places) the first edge's counts.
    Null where the hull has fewer than three corners.
    """

    def of(corners: Column) -> Column:
        def along(i: Column) -> Column:
            p, q = F.get(corners, i), F.get(corners, (i + 1) % F.size(corners))
            length = F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
            edge = F.struct(((q["x"] - p["x"]) / length).alias("x"), ((q["y"] - p["y"]) / length).alias("y"), i.alias("i"))

            def sized(u: Column) -> Column:
                a = F.transform(corners, lambda c: c["x"] * u["x"] + c["y"] * u["y"])
                b = F.transform(corners, lambda c: c["y"] * u["x"] - c["x"] * u["y"])
                return F.struct(u["i"].alias("i"), u["x"].alias("ux"), u["y"].alias("uy"), F.array_min(a).alias("a0"), F.array_max(a).alias("a1"), F.array_min(b).alias("b0"), F.array_max(b).alias("b1"))

            def measured(s: Column) -> Column:
                w, h = s["a1"] - s["a0"], s["b1"] - s["b0"]
                return F.struct(F.round(w * h, 6).alias("area"), s["i"].alias("i"), F.least(w, h).alias("short"), F.greatest(w, h).alias("long"), *(s[k].alias(k) for k in ("ux", "uy", "a0", "a1", "b0", "b1")))

            return _let(_let(edge, sized), measured)

        every = F.transform(F.sequence(F.lit(0), F.size(corners) - 1), along)
        return F.when(F.size(corners) >= 3, F.array_min(every))

    return _let(hull(points), of)


def grown_corners(r: Column, by: Column) -> Column:
    """The corners of a rectangle of ``least_rectangle`` with each side moved out: upper left, upper right, lower right,
    lower left (y down), as the two leftmost and the two rightmost, each pair from the top."""
    at = lambda a, b: _point(a * r["ux"] - b * r["uy"], a * r["uy"] + b * r["ux"])
    a0, a1, b0, b1 = r["a0"] - by, r["a1"] + by, r["b0"] - by, r["b1"] + by
    corners = F.array_sort(F.array(at(a0, b0), at(a1, b0), at(a1, b1), at(a0, b1)))

    def ordered(c: Column) -> Column:
        pair = lambda i, j: F.when(F.get(c, j)["y"] > F.get(c, i)["y"], F.array(F.get(c, i), F.get(c, j))).otherwise(F.array(F.get(c, j), F.get(c, i)))
        left, right = pair(F.lit(0), F.lit(1)), pair(F.lit(2), F.lit(3))
        return F.array(F.get(left, F.lit(0)), F.get(right, F.lit(0)), F.get(right, F.lit(1)), F.get(left, F.lit(1)))

    return _let(corners, ordered)


def outline(corners: Column, grow: Column) -> Column:
    """An array of struct(``ax``, ``ay``, ``bx``, ``by``, ``r``): what bounds a convex polygon grown by ``grow``.

    Each edge moved out to either side, a segment from a to b (``r`` null), and a disc of radius
    ``r`` about each corner a.
    """
    none = F.lit(None).cast("double")

    def shape(ax, ay, bx, by, r) -> Column:
        return F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), r.alias("r"))

    def around(p: Column, i: Column) -> Column:
        def parts(e: Column) -> Column:
            p, q, n = e["p"], e["q"], F.nullif(e["n"], F.lit(0.0))
            ox, oy = grow * (q["y"] - p["y"]) / n, grow * (p["x"] - q["x"]) / n
            moved = [shape(p["x"] + s * ox, p["y"] + s * oy, q["x"] + s * ox, q["y"] + s * oy, none) for s in (1, -1)]
            return F.array(*moved, shape(p["x"], p["y"], none, none, grow))

        q = F.get(corners, (i + 1) % F.size(corners))
        length = F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
        return _let(F.struct(p.alias("p"), q.alias("q"), length.alias("n")), parts)

    return F.flatten(F.transform(corners, around))
