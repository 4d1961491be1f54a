"""What a throttle publishes, against a loop over each key's events."""

import random

import pytest

from quirefold.streaming import pacing


def looped(events, gap):
    out, last = [], {}
    for key, order, t, forced in sorted(events, key=lambda e: (e[2] is None, e[2] or 0, e[1])):
        if t is None:
            if forced:
                out.append((key, order))
        elif forced or key not in last or round(t * 1e6) - round(last[key] * 1e6) >= round(gap * 1e6):
            out.append((key, order))
            last[key] = t
    return out


@pytest.mark.parametrize("gap", [0.25, 1.0, 7.5, 0.0])
def test_against_a_loop(spark, gap):
    rnd = random.Random(int(gap * 8))
    events, t = [], 1.7e9
    for i in range(2500):
        t += rnd.choice([0.0, 0.001, 0.05, 0.2, 0.24, 0.25, 0.26, 3.0]) * rnd.random()
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        events.append((key, i, rnd.choice([round(t, 6)] * 40 + [None]), rnd.choice([False] * 30 + [True, None])))
    df = spark.createDataFrame(events, "key string, n int, at double, forced boolean").repartition(5)
    got = [tuple(r) for r in pacing.throttle_batch(df, "key", "n", "at", "forced", gap).collect()]
    assert sorted(got, key=str) == sorted(looped(events, gap), key=str)


def test_one_long_burst(spark):
    """No event is a reset but the first: all goes by pointers."""
    events = [("k", i, i * 0.01, False) for i in range(3000)]
    df = spark.createDataFrame(events, "key string, n int, at double, forced boolean")
    got = [tuple(r) for r in pacing.throttle_batch(df, "key", "n", "at", "forced").collect()]
    assert sorted(got) == sorted(looped(events, 0.25)) and len(got) == 120


def test_empty_and_equal_times(spark):
    schema = "key string, n int, at double, forced boolean"
    assert pacing.throttle_batch(spark.createDataFrame([], schema), "key", "n", "at", "forced").collect() == []
    events = [("k", i, 5.0, i == 3) for i in range(6)]
    got = pacing.throttle_batch(spark.createDataFrame(events, schema), "key", "n", "at", "forced").collect()
    assert sorted(map(tuple, got)) == [("k", 0), ("k", 3)]
