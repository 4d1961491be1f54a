"""Reading order of pages of any size, against a loop, and places of new regions."""

import random
import statistics

from quirefold.operators import joins, order


def looped(rows, right_to_left):
    good = [r for r in rows if r[4] > r[2] and r[5] > r[3]]
    tol = statistics.median(r[5] - r[3] for r in good) / 2 if good else 0
    lines, mean = [], 0.0
    for r in sorted(good, key=lambda r: ((r[3] + r[5]) / 2, r[1])):
        y = (r[3] + r[5]) / 2
        if not lines or abs(y - mean) > tol:
            lines.append([])
            mean = y
        else:
            mean += (y - mean) / (len(lines[-1]) + 1)
        lines[-1].append(r)
    flip = -1 if right_to_left else 1
    lines.sort(key=lambda line: statistics.fmean((r[3] + r[5]) / 2 for r in line))
    out = [r[1] for line in lines for r in sorted(line, key=lambda r: (flip * (r[2] + r[4]) / 2, (r[3] + r[5]) / 2, r[1]))]
    return out + sorted(r[1] for r in rows if r not in good)


def test_against_a_loop_with_a_hot_page(spark):
    rnd = random.Random(3)
    rows = []
    for page, n in ((1, 25_000), (2, 40), (3, 1), (4, 0)):
        for i in range(n):
            x, y = rnd.randrange(2000) / 2, rnd.randrange(100 * max(1, n // 10)) / 4
            rows.append((page, i, x, y, x + rnd.randrange(0, 60), y + rnd.randrange(0, 40)))
    df = spark.createDataFrame(rows, "page int, id int, x1 double, y1 double, x2 double, y2 double").repartition(6)
    for flip in (False, True):
        got = order.reading_order(df, "page", "id", flip).orderBy("page", "nth").collect()
        for page in (1, 2, 3):
            assert [r["id"] for r in got if r["page"] == page] == looped([r for r in rows if r[0] == page], flip)


def test_new_regions_find_their_place(spark):
    square = lambda x, y: [(x, y), (x + 10, y), (x + 10, y + 10)]
    schema = "page int, points array<struct<x:int,y:int>>, text string, style string, pos int"
    old = spark.createDataFrame([(1, square(0, 0), "a", "s1", 5), (1, square(50, 0), "b", "s2", 9)], schema)
    new = [(1, square(90, 90), "low right", 0), (1, square(5, 90), "low left", 1), (1, square(50, 0), "B", 2), (1, [(0, 0), (1, 1)], "no", 3), (1, square(30, 40), "middle", 4), (2, square(1, 1), "other page", 5)]
    incoming = spark.createDataFrame(new, "page int, points array<struct<x:int,y:int>>, text string, pos int")
    got = joins.upsert_regions(old, incoming, "page").orderBy("page", "pos").collect()
    assert [(r["page"], r["pos"], r["text"], r["status"]) for r in got] == [(1, 0, "a", "kept"), (1, 1, "B", "replaced"), (1, 2, "middle", "added"), (1, 3, "low left", "added"), (1, 4, "low right", "added"), (2, 0, "other page", "added")]
    at = spark.createDataFrame([(1, 1)], "page int, at int")
    got = joins.upsert_regions(old, incoming, "page", at=at, right_to_left=True).where("page = 1").orderBy("pos").collect()
    assert [r["text"] for r in got] == ["a", "middle", "low right", "low left", "B"]
