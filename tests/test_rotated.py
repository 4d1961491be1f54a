"""Hulls, least rectangles and grown quadrilaterals, against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import rotated
from quirefold.operators import aggregate, clean

POINTS = "array<struct<x:double,y:double>>"


def plain_hull(points):
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(ps):
        out = []
        for p in ps:
            while len(out) >= 2 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def plain_rectangle(points):
    """Least area and its sides, by every edge of the hull."""
    h = plain_hull(points)
    best = None
    for i in range(len(h)):
        (px, py), (qx, qy) = h[i], h[(i + 1) % len(h)]
        n = math.hypot(qx - px, qy - py)
        ux, uy = (qx - px) / n, (qy - py) / n
        a, b = [x * ux + y * uy for x, y in h], [y * ux - x * uy for x, y in h]
        w, g = max(a) - min(a), max(b) - min(b)
        if best is None or w * g < best[0] - 1e-6:
            best = (w * g, min(w, g), max(w, g))
    return best


def contours(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        cx, cy, w, h, t = rnd.uniform(50, 300), rnd.uniform(50, 300), rnd.uniform(2, 90), rnd.uniform(2, 40), rnd.uniform(0, math.pi)
        pts = [(rnd.uniform(-w / 2, w / 2), rnd.uniform(-h / 2, h / 2)) for _ in range(rnd.choice([1, 2, 3, 8, 60]))]
        out.append([(float(round(cx + x * math.cos(t) - y * math.sin(t))), float(round(cy + x * math.sin(t) + y * math.cos(t)))) for x, y in pts])
    return [*out, [(0.0, 0.0), (5.0, 5.0), (10.0, 10.0)], [(1.0, 1.0)] * 4]


def test_hulls_and_rectangles(spark):
    made = contours(1)
    df = spark.createDataFrame(list(enumerate(made)), f"id int, p {POINTS}")
    got = {r["id"]: r for r in df.select("id", rotated.hull(F.col("p")).alias("h"), rotated.least_rectangle(F.col("p")).alias("r")).collect()}
    for i, points in enumerate(made):
        assert [(q["x"], q["y"]) for q in got[i]["h"]] == plain_hull(points)
        want = plain_rectangle(points) if len(plain_hull(points)) > 2 else None
        r = got[i]["r"]
        assert (r is None) == (want is None)
        if want:
            assert (r["area"], r["short"], r["long"]) == pytest.approx(want, abs=1e-5)


def test_boxes_from_contours(spark):
    made = contours(2)
    rows = [(1, i, p, 0.5 + (i % 6) / 10) for i, p in enumerate(made)]
    rows += [(2, 0, [(10.0, 10.0), (40.0, 10.0), (40.0, 20.0), (10.0, 20.0), (25.0, 15.0)], 0.9)]
    df = spark.createDataFrame(rows, f"page int, id int, p {POINTS}, score double")
    got = {(r["page"], r["id"]): r for r in clean.boxes_from_contours(df, "page", "id", "p", "score", ratio=1.5, width=250, height=240, most=50).collect()}
    d = 30 * 10 * 1.5 / 80
    flat = got[2, 0]
    assert flat["grow"] == pytest.approx(d) and [(p["x"], p["y"]) for p in flat["box"]] == [(4, 4), (46, 4), (46, 26), (4, 26)]
    for i, (_, _, points, score) in enumerate(rows[:-1]):
        want = plain_rectangle(points) if len(plain_hull(points)) > 2 else None
        kept = bool(want) and i < 50 and score >= 0.6 and want[1] >= 3
        if kept:
            grow = want[1] * want[2] * 1.5 / (2 * (want[1] + want[2]))
            kept = want[1] + 2 * grow >= 5
        assert ((1, i) in got) == kept
        if kept:
            assert got[1, i]["grow"] == pytest.approx(grow, abs=1e-5)
            box = [(p["x"], p["y"]) for p in got[1, i]["box"]]
            assert all(0 <= x <= 250 and 0 <= y <= 240 for x, y in box)
            inside = [p for p in points if 5 < p[0] < 245 and 5 < p[1] < 235]
            assert all(min(x for x, _ in box) - 1 <= p[0] <= max(x for x, _ in box) + 1 for p in inside)


def distance(px, py, quad):
    """From a polygon's inside, 0, or its edges."""
    inside = {(bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0 for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1], strict=True) if (ax, ay) != (bx, by)}
    best = math.inf
    for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1], strict=True):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if n == 0 else max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n))
        best = min(best, math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(quad, quad[1:] + quad[:1], strict=True)))
    return 0.0 if inside == {True} and area else best


def test_painted_cells_against_a_test_of_each(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(14):
        cx, cy, w, h, t = rnd.uniform(10, 70), rnd.uniform(10, 50), rnd.uniform(1, 60), rnd.uniform(1, 30), rnd.choice([0, math.pi / 2, rnd.uniform(0, 3)])
        quad = [(cx + x * math.cos(t) - y * math.sin(t), cy + x * math.sin(t) + y * math.cos(t)) for x, y in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]
        rows.append((i % 3, quad, round(0.3 + i * 0.04, 2), 80, 60))
    df = spark.createDataFrame(rows, f"page int, p {POINTS}, score double, width int, height int")
    runs = aggregate.paint_rotated(df, "page", "p").collect()
    got = {}
    for r in runs:
        for x in range(r["x1"], r["x2"] + 1):
            assert (r["page"], r["y"], x) not in got
            got[r["page"], r["y"], x] = r["score"]
    want = {}
    for page, quad, score, w, h in rows:
        if score <= 0.35:
            continue
        short = plain_rectangle(quad)[1]
        pad = round(min(max(0.03 * short, 2), 12))
        whole = [(float(round(x)), float(round(y))) for x, y in quad]
        for y in range(h):
            for x in range(w):
                if distance(x, y, whole) <= pad + 1e-9:
                    want[page, y, x] = max(score, want.get((page, y, x), 0))
    assert got == want and len(want) > 2000


def test_painting_and_contours_work_each_rectangle_out_once_in_every_task(spark):
    quad = [(10.0, 2.0), (30.0, 12.0), (10.0, 22.0), (-10.0, 12.0)]
    one = spark.createDataFrame([(i // 8, i, quad, 0.9, 40, 30) for i in range(64)], f"page int, id int, p {POINTS}, score double, width int, height int").coalesce(1)
    found = clean.boxes_from_contours(one, "page", "id", "p", "score")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1 and "RepartitionByExpression" in plan
    runs = aggregate.paint_rotated(one, "page", "p")
    assert {(r["page"], r["y"], r["x1"], r["x2"]) for r in runs.where("y = 12").collect()} == {(p, 12, 0, 32) for p in range(8)}


def test_outline_of_a_box_and_of_a_point(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, [(5.0, 5.0)] * 4)], f"id int, p {POINTS}")
    rows = df.select("id", F.inline(rotated.outline(F.col("p"), F.lit(2.0)))).collect()
    assert len(rows) == 24 and sum(r["r"] == 2.0 for r in rows) == 8
    box = {(r["ax"], r["ay"], r["bx"], r["by"]) for r in rows if r["id"] == 1 and r["r"] is None}
    assert {(0.0, -2.0, 4.0, -2.0), (6.0, 0.0, 6.0, 3.0), (4.0, 5.0, 0.0, 5.0), (-2.0, 3.0, -2.0, 0.0)} <= box
    painted = aggregate.paint_rotated(df.select(F.lit(1).alias("page"), "p", F.lit(0.9).alias("score")).where("p[0].x = 5"), "page", "p").collect()
    assert sorted((r["y"], r["x1"], r["x2"]) for r in painted) == [(3, 5, 5), (4, 4, 6), (5, 3, 7), (6, 4, 6), (7, 5, 5)]
