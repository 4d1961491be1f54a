"""Names in texts, against a search for each name."""

import random

import pytest

from quirefold.operators import joins


def pairs(spark, texts, roster, **more):
    t = spark.createDataFrame(texts, "id int, t string")
    r = spark.createDataFrame(roster, "m string, n1 string, n2 string")
    return sorted(((x["id"], x["m"]) for x in joins.mentions(t, r, "t", "m", ["n1", "n2"], **more).collect()), key=str)


def searched(texts, roster):
    out = set()
    for n, (i, t) in enumerate(texts):
        out |= {(n, i, m) for m, *names in roster for x in names if x and t and x in t}
    return sorted(((i, m) for _, i, m in out), key=str)


def test_small(spark):
    texts = [(1, "xAnna met Bo."), (2, "nobody"), (3, None), (4, ""), (1, "xAnna met Bo.")]
    roster = [("a", "Anna", None), ("b", "Bo", ""), ("c", "Zed", "met Bo"), ("c", "An", None), (None, "met", None)]
    got = pairs(spark, texts, roster)
    assert got == searched(texts, roster) and len(got) == 8
    assert pairs(spark, [], roster) == [] == pairs(spark, texts, [])


@pytest.mark.parametrize("part_chars", [4_000_000, 3000])
def test_many_names(spark, part_chars):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abé界") for _ in range(n))
    roster = [(f"k{i % 2500}", word(rnd.randrange(3, 9)), rnd.choice([None, "", word(5)])) for i in range(3000)]
    texts = [(i, word(rnd.randrange(0, 300))) for i in range(150)]
    got = pairs(spark, texts, roster, part_chars=part_chars)
    assert got == searched(texts, roster) and len(got) > 1000


def test_a_hundred_thousand_names(spark):
    roster = spark.range(100_000).selectExpr("id AS m", "concat('name', id, '.') AS n1")
    texts = spark.range(300).selectExpr("id", "concat('see name', id * 333, '. and name', id, '. or nam5.') AS t")
    got = {(r["id"], r["m"]) for r in joins.mentions(texts, roster, "t", "m", ["n1"]).collect()}
    assert got == {(i, k) for i in range(300) for k in (i * 333, i)}
