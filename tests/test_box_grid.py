"""Pairs of boxes of very different size, against all pairs."""

import itertools
import random

import pytest

from quirefold.operators import joins

SCHEMA = "page int, id int, x1 double, y1 double, x2 double, y2 double, score double"


def drawn(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(260):
        page = rnd.randrange(2)
        size = rnd.choice([1, 5, 30, 127, 128, 129, 700, 4000])
        x, y = rnd.randrange(-300, 15_000) + rnd.choice([0, 0.5]), rnd.randrange(-300, 15_000)
        if rnd.random() < 0.6:
            x, y = x % 600, y % 600
        rows.append((page, i, float(x), float(y), x + size * rnd.choice([1.0, 0.1]), float(y + size), rnd.random()))
        if rnd.random() < 0.4:  # a near copy
            p, _, *r, s = rows[-1]
            rows.append((p, 1000 + i, *(v + rnd.choice([0, 0, 1, -2, 0.01 * size]) for v in r), s))
    return [*rows, (0, 5000, 0.0, 0.0, 16_000.0, 16_000.0, 0.5), (0, 5001, 10.0, 10.0, 10.0, 10.0, 0.9)]


@pytest.mark.parametrize("margin", [0.0, 12.0])
def test_overlaps(spark, margin):
    rows = drawn(int(margin))
    got = joins.overlaps(spark.createDataFrame(rows, SCHEMA), "page", "id", margin).select("a.id", "b.id").collect()
    want = set()
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        if a[0] == b[0] and all(a[k] - margin < b[k + 2] + margin and b[k] - margin < a[k + 2] + margin for k in (2, 3)):
            want.add((a[1], b[1]))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300


def test_near_duplicates(spark):
    rows = drawn(7)
    got = joins.near_duplicates(spark.createDataFrame(rows, SCHEMA), "page", "id").select("a.id", "b.id").collect()
    want = set()
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        (aw, ah), (bw, bh) = ((r[4] - r[2], r[5] - r[3]) for r in (a, b))
        near = max(2, 0.02 * max(aw, ah, bw, bh))
        if a[0] == b[0] and min(aw * ah, bw * bh) > 0 and min(aw * ah, bw * bh) >= 0.97 * max(aw * ah, bw * bh):
            if all(abs(a[k] - b[k]) <= near for k in (2, 3)) and abs(aw - bw) <= near and abs(ah - bh) <= near:
                want.add((a[1], b[1]))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_a_large_box_takes_few_cells(spark):
    rows = [(1, i, i * 20.0, 0.0, i * 20.0 + 10, 10.0, 0.5) for i in range(700)] + [(1, 9000 + i, -i, -i, 16_000.0 + i, 16_000.0, 0.6) for i in range(5)]
    pairs = joins.overlaps(spark.createDataFrame([(p, i, *map(float, r)) for p, i, *r in rows], SCHEMA), "page", "id")
    assert pairs.count() == 700 * 5 + 10
    plan = pairs._jdf.queryExecution().executedPlan()
    from_joins = []

    def walk(node):
        if "Generate" in node.nodeName():
            from_joins.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    pairs.collect()
    walk(plan)
    assert from_joins and max(from_joins) <= 4 * 2 * 705  # four cells on each of two levels, at most


def test_accepted_pieces(spark):
    """Pieces of one cut: slivers, the source, what the page has, and near-copies of a kept piece go."""
    square = lambda x, y, w, h: [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]
    made = [(1, "whole", square(0, 0, 100, 80)), (2, "shaved", square(1, 0, 99, 80)), (3, "left", square(0, 0, 48, 80)), (4, "left again", square(1, 1, 48, 80)),
            (5, "right", square(52, 0, 48, 80)), (6, "had", square(10, 10, 30, 30)), (7, "sliver", square(0, 0, 1, 80)), (8, "line", square(0, 0, 5, 5)[:2]), (9, "own", square(20, 20, 40, 40))]
    point = "array<struct<x:double,y:double>>"
    pieces = spark.createDataFrame([(7, n, r, p) for r, n, p in made], f"source int, piece string, rank int, points {point}")
    sources = spark.createDataFrame([(7, 1, square(0, 0, 100, 80))], f"source int, page int, points {point}")
    regions = spark.createDataFrame([(8, 1, square(10, 10, 30, 30)), (7, 1, square(20, 20, 40, 40)), (9, 2, square(0, 0, 48, 80))], f"source int, page int, points {point}")
    got = joins.accept_regions(pieces, sources, regions, "source", "piece", "page").collect()
    assert sorted(r["piece"] for r in got) == ["left", "own", "right"]


def test_small_pages_meet_without_cells_and_large_ones_on_the_grid(spark, monkeypatch):
    rnd = random.Random(11)
    rows = []
    for page, n in ((1, joins.FEW), (2, joins.FEW + 1), (3, 2)):
        for i in range(n):
            x, y = rnd.uniform(0, 600), rnd.uniform(0, 600)
            rows.append((page, 1000 * page + i, x, y, x + rnd.choice([3, 40, 500]), y + rnd.choice([3, 40, 500])))
    df = spark.createDataFrame(rows, "page int, id int, x1 double, y1 double, x2 double, y2 double")
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]}
    labels, real = [], joins.materialise

    def seen(made, label):
        out = real(made, label)
        labels.append((label, out))
        return out

    monkeypatch.setattr(joins, "materialise", seen)
    got = [(r["page"], r["a"]["id"], r["b"]["id"]) for r in joins.overlaps(df, "page", "id").collect()]
    assert set(got) == want and len(got) == len(want) and {p for p, _, _ in got} >= {1, 2}
    [(_, boxes)] = [x for x in labels if x[0] == "pairs-boxes"]
    assert boxes.count() == len(rows)
