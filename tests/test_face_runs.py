"""W9 of whole texts against W9 of characters."""

from pyspark.sql import functions as F

from quirefold.operators import order

FACES = {"a": [(0x20, 0x7E)], "b": [(0x40, 0xFF), (0x1F600, 0x1F64F)], "c": [(0xC0, 0x24F), (0x0A, 0x0A)]}
TEXTS = ["plain", "", None, "\n\n", "caf\u00e9 \u0101\u0102!", "\U0001F600\U0001F601x\u4e00\u4e00-^]&&[\\", "\u00e9" * 5000 + "x", "\u0000\u0000 a"]


def test_against_characters(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    got = order.text_face_runs(docs, "k", "t", FACES).collect()

    def face(c):
        return next((f for f, ranges in FACES.items() if any(a <= ord(c) <= b for a, b in ranges)), "missing")

    chars = [(k, i + 1, face(c)) for k, t in enumerate(TEXTS) for i, c in enumerate(t or "")]
    want = order.face_runs(spark.createDataFrame(chars, "k int, pos long, face string"), "k", "pos", "face")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("k", F.col("run").cast("long"), "face", "start", "length").collect()))
    assert order.text_face_runs(docs.limit(0), "k", "t", FACES).collect() == []
