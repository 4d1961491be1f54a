"""Crops of clusters and counts of holes, against a count cell by cell."""

import random

from quirefold.operators import crops


def plain_crop(w, h, holes, x1, y1, x2, y2):
    margin = int(min(max(0.6 * max(x2 - x1, y2 - y1), 28), 140))
    for _ in range(4):
        left, top, right, bottom = max(0, x1 - margin), max(0, y1 - margin), min(w, x2 + margin), min(h, y2 + margin)
        inside = sum(left <= x < right and top <= y < bottom for x, y in holes)
        share = 1 - inside / ((right - left) * (bottom - top))
        last = (margin, left, top, right, bottom, round(share, 9))
        if share >= 0.45 or margin >= 320:
            break
        margin = int(margin * 1.6)
    return last


def test_crops_against_a_loop(spark):
    rnd = random.Random(5)
    pages, cells, clusters, want = [], [], [], {}
    for p in range(7):
        w, h = rnd.choice([(300, 210), (64, 96), (900, 500), (33, 31)])
        dense = rnd.choice([0.02, 0.6, 0.9, 1.0, 0.0])
        cx, cy = rnd.randrange(w), rnd.randrange(h)
        holes = {(x, y) for x in range(max(0, cx - 130), min(w, cx + 130)) for y in range(max(0, cy - 110), min(h, cy + 110)) if rnd.random() < dense}
        pages.append((p, w, h))
        cells += [(p, x, y) for x, y in holes]
        for b in range(4):
            x1, y1 = rnd.randrange(max(1, w - 12)), rnd.randrange(max(1, h - 12))
            box = (x1, y1, x1 + rnd.randrange(1, 300), y1 + rnd.randrange(1, 90))
            clusters.append((p, b, *box))
            want[p, b] = plain_crop(w, h, holes, *box)
    cells += cells[:50]
    got = crops.cluster_crops(
        spark.createDataFrame([*clusters, (99, 0, 1, 1, 5, 5)], "page int, box int, x1 int, y1 int, x2 int, y2 int"),
        spark.createDataFrame(cells, "page int, x int, y int"),
        spark.createDataFrame(pages, "page int, width int, height int"),
        "page",
        "box",
    ).collect()
    assert {(r["page"], r["box"]): (r["margin"], r["left"], r["top"], r["right"], r["bottom"], round(r["share"], 9)) for r in got} == want
    assert sorted(r["rank"] for r in got if r["page"] == 0) == [1, 2, 3, 4]


def test_area_ranks_and_no_holes(spark):
    pages = spark.createDataFrame([(1, 100, 100)], "page int, width int, height int")
    none = spark.createDataFrame([], "page int, x int, y int")
    c = spark.createDataFrame([(1, 1, 0, 0, 50, 50, 10), (1, 2, 5, 5, 9, 9, 90)], "page int, box int, x1 int, y1 int, x2 int, y2 int, area int")
    got = {r["box"]: (r["rank"], r["share"], r["margin"]) for r in crops.cluster_crops(c, none, pages, "page", "box").collect()}
    assert got == {2: (1, 1.0, 28), 1: (2, 1.0, 30)}
