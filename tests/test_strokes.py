"""Depths against the nearest cell, and colours of drawn regions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import strokes


@pytest.mark.parametrize("seed", range(3))
def test_depth_is_the_distance_to_the_nearest_other_cell(spark, seed):
    rnd = random.Random(seed)
    cells, bounds, want = [], [], {}
    for g in range(12):
        w, h = rnd.randrange(1, 22), rnd.randrange(1, 22)
        share = rnd.choice([0.3, 0.8, 0.95, 0.99, 1.0])
        x0, y0 = rnd.randrange(-5, 5), rnd.randrange(-5, 5)
        every = [(x, y) for x in range(x0, x0 + w) for y in range(y0, y0 + h)]
        own = [c for c in every if rnd.random() < share]
        other = set(every) - set(own)
        cells += [(g, x, y) for x, y in own]
        bounds.append((g, x0, x0 + w - 1, y0, y0 + h - 1))
        for x, y in own:
            want[g, x, y] = min((math.dist((x, y), o) for o in other), default=None)
    got = strokes.depth(
        spark.createDataFrame(cells, "g int, x int, y int"), "g", spark.createDataFrame(bounds, "g int, x0 int, x1 int, y0 int, y1 int")
    ).collect()
    found = {(r["g"], r["x"], r["y"]): r["depth"] for r in got}
    assert found.keys() == want.keys() and len(got) == len(want)
    for k, v in want.items():
        assert found[k] == (None if v is None else pytest.approx(v))


def field(width, height, colour):
    return {(x, y): colour for x in range(width) for y in range(height)}


def bars(px, colour, width, gap, top, bottom, left, right):
    x = left
    while x + width <= right:
        px.update({(i, y): colour for i in range(x, x + width) for y in range(top, bottom)})
        x += width + gap


def read(spark, fields, zone=lambda g, x, y: "rest"):
    rows = [(g, x, y, *c, zone(g, x, y)) for g, px in fields.items() for (x, y), c in px.items()]
    df = spark.createDataFrame(rows, "g string, x int, y int, r int, g_ int, b int, zone string").withColumn("region", F.col("g"))
    got = strokes.region_colours(df.select("region", "x", "y", "r", F.col("g_").alias("g"), "b", "zone"), "region").collect()
    return {r["region"]: tuple(c and tuple(c) for c in (r["plate"], r["ink"], r["rim"])) for r in got}


def test_drawn_regions(spark):
    rnd = random.Random(4)
    sfx = field(120, 70, (120, 118, 125))
    bars(sfx, (0, 0, 0), 15, 9, 10, 60, 10, 110)
    bars(sfx, (255, 255, 255), 5, 19, 10, 60, 15, 110)
    plain = field(80, 60, (255, 255, 255))
    bars(plain, (0, 0, 0), 5, 7, 10, 50, 8, 72)
    thin = field(80, 60, (250, 250, 250))
    bars(thin, (20, 20, 20), 2, 6, 10, 50, 8, 72)
    paper = field(60, 45, (240, 236, 228))
    slope = {(x, y): (x * 3, x * 3, x * 3) for x in range(80) for y in range(20)}
    noise = {k: tuple(c + rnd.randrange(-3, 4) for c in v) for k, v in field(60, 45, (200, 200, 200)).items()}
    got = read(spark, {"sfx": sfx, "plain": plain, "thin": thin, "paper": paper, "slope": slope, "noise": noise})
    assert got["sfx"] == ((120, 118, 125), (255, 255, 255), (0, 0, 0))
    assert got["plain"] == ((255, 255, 255), (0, 0, 0), None)
    assert got["thin"] == ((250, 250, 250), (20, 20, 20), None)
    assert got["paper"] == ((240, 236, 228), None, None)
    assert got["slope"][1:] == (None, None)
    assert got["noise"][1:] == (None, None)


def test_artwork_outside_the_zone_is_not_the_plate(spark):
    px = field(240, 160, (255, 255, 255))
    px.update({(x, y): (200, 30, 40) for x in range(120, 240) for y in range(160)})
    bars(px, (0, 0, 0), 5, 7, 40, 110, 20, 110)

    def zone(g, x, y):
        if 18 <= x <= 112 and 38 <= y <= 112:
            return "zone" if g == "zoned" else "rest"
        return "ring" if 14 <= x <= 116 and 34 <= y <= 116 else "rest"

    got = read(spark, {"zoned": px}, zone)
    assert got["zoned"] == ((255, 255, 255), (0, 0, 0), None)


def test_a_small_zone_is_none(spark):
    px = field(40, 30, (255, 255, 255))
    bars(px, (0, 0, 0), 4, 6, 5, 25, 4, 36)
    got = read(spark, {"small": px}, lambda g, x, y: "zone" if x < 6 and y < 10 else "ring")
    assert got["small"][:2] == ((255, 255, 255), (0, 0, 0))
    assert read(spark, {"a": {(0, 0): (9, 9, 9)}})["a"] == ((9, 9, 9), None, None)


def test_repeated_pixels_and_null_zones(spark):
    px = field(40, 30, (255, 255, 255))
    bars(px, (0, 0, 0), 4, 6, 5, 25, 4, 36)
    rows = [(1, x, y, *c, None) for (x, y), c in px.items()] * 2
    df = spark.createDataFrame(rows, "id int, x int, y int, r int, g int, b int, zone string")
    (got,) = strokes.region_colours(df, "id").collect()
    assert (tuple(got["plate"]), tuple(got["ink"]), got["rim"]) == ((255, 255, 255), (0, 0, 0), None)
    assert strokes.region_colours(df.limit(0), "id").collect() == []


def test_pixels_that_lie_together_are_not_shuffled_and_listed_colours_change_nothing(spark, monkeypatch):
    px = field(60, 45, (250, 250, 250))
    bars(px, (20, 20, 20), 6, 6, 8, 36, 6, 54)
    rows = [(1, x, y, *c, "rest") for (x, y), c in px.items()]
    df = spark.createDataFrame(rows, "id int, x int, y int, r int, g int, b int, zone string")
    (listed,) = strokes.region_colours(df, "id").collect()
    monkeypatch.setattr(strokes, "MOST_LISTED", 0)
    assert strokes.region_colours(df, "id").collect() == [listed]
    assert tuple(listed["ink"]) == (20, 20, 20)
    body = df.where("r < 100").repartition(4, "id").select("id", "x", "y", "r")
    sizes = df.groupBy("id").agg(*(F.expr(f"{f}({c})").alias(c + e) for c in "xy" for f, e in (("min", "0"), ("max", "1"))))
    deep = strokes.depth(body, "id", sizes)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 2  # the pixels as given and their bounds
    assert deep.columns == ["id", "x", "y", "r", "depth"] and deep.count() == body.count()
