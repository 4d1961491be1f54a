"""Sharding of many equal rows, whatever the layout, and the evenness of the shuffle."""

import collections

from pyspark.sql import functions as F

from quirefold.llm import sharding


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    rows = [(1, "same") for _ in range(400)] + [(i, "t") for i in range(2, 700)] + [(None, None)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    keep = sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda d, label: (made.append((label, keep(d, label))), made[-1][1])[1])
    got = {n: sharding.shard(df.repartition(n), 8) for n in (3, 7)}
    placed = {n: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in d.collect()) for n, d in got.items()}
    assert placed[3] == placed[7]  # the layout does not matter
    blocks = next(d for label, d in made if label == "shard-blocks").groupBy("__block").count().collect()
    assert max(r["count"] for r in blocks) < 110
    sizes = collections.Counter(s for _, s, _ in placed[3])
    assert sorted(sizes.values()) == sorted(sharding.shard_sizes(len(rows), 8))
    same = collections.Counter(s for i, s, _ in placed[3] if i == "1")
    assert len(same) == 8 and max(same.values()) < 85  # 50 each on average
    halves = collections.Counter(slot < 75 for i, _, slot in placed[3] if i == "1")
    assert abs(halves[True] - halves[False]) < 80


def test_merge_joins_give_the_same(spark, monkeypatch):
    df = spark.range(500).withColumn("text", F.lit("x"))
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    small = sorted(map(tuple, sharding.shard(df, 8).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_NUMBERS", 0)
    assert sorted(map(tuple, sharding.shard(df, 8).collect())) == small
