"""The order sample: inclusion frequencies against inclusion odds, and long documents in small sources."""

import collections

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import mixing


def plain_expected(sizes, target, most, tilt):
    """Copies in proportion to size ** tilt (in steps of a fiftieth), at most ``most``, that give ``target`` words."""
    g = np.exp(np.floor(np.log(sizes) * tilt * mixing.MEASURE_STEPS + 1e-12) / mixing.MEASURE_STEPS)
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(most, mid * g) * sizes).sum() < target else (low, mid)
    return np.minimum(most, low * g)


def test_frequencies_follow_the_odds(spark):
    rng = np.random.default_rng(6)
    sizes = np.exp(rng.normal(4, 0.8, 500)).astype(int) + 2
    sources = 120  # one document a source closes its gap, so sources are not small
    rows = [(j, f"s{i:03}", int(n)) for i in range(sources) for j, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    for share in (0.4, 1.3):
        got = mixing.mix(df, size_col="n", weights=(1,), share=share, with_expected=True).collect()
        want = plain_expected(sizes, share * sizes.sum(), 2.0, 0.5)
        copies, taken = collections.defaultdict(list), collections.Counter()
        for r in got:
            assert abs(r["expected"] - want[r["doc_id"]]) < 0.03
            assert r["copies"] >= int(r["expected"])
            copies[r["doc_id"]].append(r["copies"])
            taken[r["source"]] += r["taken"]
        assert all(abs(v - share * sizes.sum()) < 0.05 * sizes.sum() for v in taken.values())
        off = [np.mean(copies[j]) - want[j] for j in range(len(sizes))]
        assert np.mean(np.abs(off)) < 0.05 and abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.25, off
        odds = [want[j] % 1 for j in range(len(sizes))]
        assert max(odds) - min(odds) > 0.3  # they differ inside a source


def test_one_long_document(spark):
    rows = [(i, "a", 10) for i in range(100)] + [(100, "a", 5000), (200, "b", 3000), (201, "b", 1), (300, "c", 0), (None, None, 7), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(df, size_col="n", share=0.5).collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(10, 2600 * (s in "ab" if s else False)) for s in target), (taken, target)


def test_tilt_zero_and_weights(spark):
    df = spark.createDataFrame([(i, "a", 5 + i % 7, float(i % 3)) for i in range(300)], "doc_id long, source string, n long, w double")
    even = mixing.mix(df, size_col="n", share=0.5, tilt=0.0, with_expected=True)
    assert [r[0] for r in even.agg(F.max("expected") - F.min("expected")).collect()] == [0.0]
    heavy = mixing.mix(df, size_col="n", weight_col="w", share=0.5).collect()
    assert all(r["copies"] == 0 for r in heavy if r["w"] == 0)


def test_equal_and_null_ids(spark):
    """Sources of equal rows come within a document of their target, whatever the partitions."""
    rows = [(None, s, 10) for s in "abc" for _ in range(200)]
    rows += [(i % 2, "d", 7) for i in range(200)] + [(None, None, 3)] * 90 + [(5, "e", 4), (6, "e", 9)]
    seen = []
    for parts in (1, 5, 9):
        df = spark.createDataFrame(rows, "doc_id long, source string, n long").repartition(parts)
        got = mixing.mix(df, size_col="n").collect()
        assert len(got) == len(rows)
        taken, target, size = collections.Counter(), {}, {}
        for r in got:
            taken[r["source"]] += r["taken"]
            target[r["source"]], size[r["source"]] = r["target"], r["size"]
            assert 0 <= r["copies"] <= 2
        assert all(abs(taken[s] - target[s]) <= max(9, size[s]) for s in target), (taken, target)
        seen.append(sorted(map(str, ((r["doc_id"], r["source"], r["copies"]) for r in got))))
    assert seen[0] == seen[1] == seen[2]


def test_repeated_rows_among_others(spark):
    """A third of all rows alike: half of them once, half twice, or so."""
    rows = [(1, "a", 6)] * 100 + [(i, "a", 1 + i % 11) for i in range(2, 202)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(df, size_col="n", tilt=0.0).collect()
    total = sum(n for *_, n in rows)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 11
    like = collections.Counter(r["copies"] for r in got if r["doc_id"] == 1)
    assert set(like) == {1, 2} and 25 <= like[2] <= 75
