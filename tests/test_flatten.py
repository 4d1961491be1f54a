"""X4 against a walk over what Python's reader gives."""

import json
import random

from pyspark.sql import functions as F

from quirefold.functions import payload


def walk(x):
    if isinstance(x, dict):
        return [s for v in x.values() for s in walk(v)]
    if isinstance(x, list):
        return [s for v in x for s in walk(v)]
    if x is None or x == "":
        return []
    return [str(x).lower() if isinstance(x, bool) else str(x)]


def made(draw, depth):
    kind = draw.randrange(9 if depth else 7)
    if kind < 3:
        return "".join(draw.choice(list('ab "\\\\:,[]{}\n\t\u00e9\U0001F600') + ["true", "1"]) for _ in range(draw.randrange(7)))
    if kind < 7:
        return [None, draw.choice([True, False]), draw.randrange(-99, 10**9), draw.randrange(-99, 99) + 0.5][kind - 3]
    n = draw.randrange(4)
    return [made(draw, depth - 1) for _ in range(n)] if kind == 7 else {f'k"{draw.randrange(99)}\\': made(draw, depth - 1) for _ in range(n)}


def test_against_walk(spark):
    draw = random.Random(3)
    texts = [json.dumps(made(draw, 5), ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])) for _ in range(500)]
    texts += ["[" * 60 + '"in"' + "]" * 60, json.dumps("\\\"" * 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, p string").select("k", payload.flatten_strings(F.col("p")).alias("s"))
    assert {r["k"]: r["s"] for r in df.collect()} == {k: walk(json.loads(t)) for k, t in enumerate(texts)}


def test_no_json(spark):
    df = spark.createDataFrame([(None,), ("",), ("bad{",), ("[1,2",), ("[]",), ("null",)], "p string")
    assert [r["s"] for r in df.select(payload.flatten_strings(F.col("p")).alias("s")).collect()] == [[]] * 6
