"""Periodic runs against a scan of every period."""

import hashlib
import random
import time
import zlib

import pytest

from quirefold.llm import periods, queries


def brute(words, min_length=24, min_periods=3):
    """Every stretch of every period, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_periods * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def mixed_words(rnd):
    few, words = rnd.choice([1, 2, 2, 3, 5, 50]), []
    while len(words) < rnd.choice([30, 80, 200, 400]):
        kind = rnd.random()
        if kind < 0.35:
            words += [rnd.randrange(few) for _ in range(rnd.randrange(1, 20))]
        elif kind < 0.8:
            part = [rnd.randrange(few) for _ in range(rnd.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 25, 33, 40]))]
            length = rnd.randrange(1, 6 * len(part) + 20)
            words += (part * (length // len(part) + 1))[:length]
        elif words:
            at = rnd.randrange(len(words))
            words += words[at : at + rnd.randrange(1, 60)]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_against_every_period(seed):
    rnd = random.Random(seed)
    met = 0
    for _ in range(300):
        words = mixed_words(rnd)
        want = brute(words)
        met += len(want)
        assert periods.periodic_runs(words) == want
    assert met > 100


def test_other_bounds():
    rnd = random.Random(99)
    for _ in range(200):
        words = mixed_words(rnd)
        assert periods.periodic_runs(words, 40, 5) == brute(words, 40, 5)
    with pytest.raises(ValueError):
        periods.periodic_runs(words, 10, 2)


def test_long_repeats_take_linear_time():
    began = time.time()
    assert periods.periodic_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    assert periods.periodic_runs(["a", "b"] * 150_000) == [(0, 300_000, 2)]
    block = ["a"] * 500 + [str(i) for i in range(500)]
    found = periods.periodic_runs(block * 100)
    assert (0, 100_000, 1000) in found and len(found) == 101
    assert time.time() - began < 30


def test_kept_words():
    words = list("xyzabcabcabcabcabcabcabcabcab") + ["end"]
    runs = periods.periodic_runs(words)
    assert runs == [(3, 26, 3)] == brute(words)
    assert "".join(periods.kept_words(words, runs)) == "xyzabcend"


def test_texts_and_columns(spark):
    line = " ".join(["to be or not"] * 10)
    rows = [(1, None, "p"), (2, "", "p"), (3, " \t\n", "p"), (4, line, "p"), (4, line, "p"), (None, line + " x", "q"), (5, "once only", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic string")
    got = periods.scan(docs).select("doc_id", "text", "periodic.*").collect()
    assert len(got) == len(rows)
    for row in got:
        words = (row["text"] or "").encode().split()
        want = brute(words)
        assert [tuple(r) for r in row["runs"]] == want
        assert row["collapsed"] == b" ".join(periods.kept_words(words, want)).decode()
    assert periods.scan(docs.limit(0)).collect() == []


def test_query_rows(spark, tmp_path):
    rnd = random.Random(5)
    texts = [" ".join(map(str, mixed_words(rnd))) for _ in range(120)] + [None, "", "one", "  a\x0bb c  "]
    rows = [(i * 7 + 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    tails = 0
    for doc_id, text in rows:
        h = zlib.crc32(str(doc_id).encode())
        words = (text or "").encode().split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            tails += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        dropped = {i for a, b, q in runs for i in range(a + q, a + b)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want = [
            doc_id,
            len(runs),
            *((*best, 1000 * best[1] // best[2]) if best else [None] * 4),
            hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
        ]
        assert list(got[doc_id]) == want
    assert tails > 3
