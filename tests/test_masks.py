"""Masks as runs, against the same on cells."""

import itertools
import math
import random

import pytest

from quirefold.operators import masks


def drawn(seed, pages=3, w=90, h=70):
    rnd = random.Random(seed)
    out = []
    for p in range(pages):
        for _ in range(rnd.randrange(1, 14)):
            x, y = rnd.randrange(w), rnd.randrange(h)
            out += [(p, y + j, x + i) for i in range(rnd.randrange(1, 9)) for j in range(rnd.randrange(1, 5))]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "page int, y int, x int")


def grouped(points):
    """Components of cells, eight neighbours each."""
    left, out = set(points), {}
    while left:
        first = left.pop()
        todo, group = [first], {first}
        while todo:
            y, x = todo.pop()
            for n in itertools.product((y - 1, y, y + 1), (x - 1, x, x + 1)):
                if n in left:
                    left.remove(n)
                    group.add(n)
                    todo.append(n)
        for c in group:
            out[c] = first
    return out


@pytest.mark.parametrize("gap", [1, 5, 12])
def test_clusters_against_cells(spark, gap):
    rows = drawn(gap)
    got = masks.clusters(masks.runs(frame(spark, rows), "page"), "page", gap).collect()
    found = {(r["page"], r["y"], x): r["component"] for r in got for x in range(r["x1"], r["x2"] + 1)}
    assert found.keys() == set(rows)
    wide = {dy: round(math.sqrt(gap * gap - dy * dy)) for dy in range(-gap, gap + 1)}
    for p in {r[0] for r in rows}:
        own = {(y, x) for q, y, x in rows if q == p}
        grown = {(y + dy, x + dx) for y, x in own for dy, w in wide.items() for dx in range(-w, w + 1)}
        groups = grouped(grown)
        least = {}
        for c in own:
            least[groups[c]] = min(least.get(groups[c], c), c)
        for y, x in own:
            a, b = least[groups[y, x]]
            assert found[p, y, x] == p * (1 << 40) + a * (1 << 20) + b


def test_union_and_intersection(spark):
    a, b = drawn(21), drawn(22, pages=2)
    ra, rb = (masks.runs(frame(spark, r), "page") for r in (a, b))
    assert sorted(map(tuple, masks.cells(masks.union("page", ra, rb), "page").collect())) == sorted(set(a) | set(b))
    assert sorted(map(tuple, masks.cells(masks.intersection(ra, rb, "page"), "page").collect())) == sorted(set(a) & set(b))
    assert masks.union("page", ra, ra).count() == ra.count()


def test_long_runs_cost_few_rows(spark):
    long = spark.createDataFrame([(1, 5, 0, 100_000), (1, 40, 0, 100_000), (1, 40, 100_020, 100_021), (1, 90, 3, 4)], "page int, y int, x1 int, x2 int")
    assert masks.dilated(long, "page", 12).count() <= 4 * 25
    got = {(r["y"], r["x1"]): r["component"] for r in masks.clusters(long, "page", 12).collect()}
    assert len(set(got.values())) == 3 and got[40, 0] == got[40, 100_020] != got[5, 0]


def test_empty(spark):
    none = frame(spark, [])
    assert masks.clusters(masks.runs(none, "page"), "page").count() == 0
