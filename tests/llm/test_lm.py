"""Language-model scores against plain Python."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.llm import lm, queries

SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def corpus(rnd, n):
    names = [f"W{i}" for i in range(40)]
    rows = []
    for i in range(n):
        at, words = rnd.randrange(40), []
        for _ in range(rnd.randrange(0, 60)):
            at = (at * 3 + rnd.choice([1, 1, 1, 2])) % 40 if rnd.random() < 0.8 else rnd.randrange(40)
            words.append(names[at] if rnd.random() < 0.97 else f"rare{rnd.randrange(10**6)}")
        rows.append((i, " ".join(words)))
    return rows


def mixed(context_counts, estimates, weights, floor):
    p = floor
    for c, f, w in zip(context_counts, estimates, weights, strict=True):
        own = w[1 + int(math.log2(c))] if c else 0.0
        p = own * f + (1 - own) * p
    return p


def counts(texts, order):
    grams, starts = Counter(), 0
    for t in texts:
        starts += 1
        seq = ["^"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(seq)):
            for n in range(1, order + 1):
                grams[tuple(seq[i - n + 1 : i + 1])] += 1
    return grams, starts


def looked_up(text, grams, starts, total, order):
    """For each token, context counts and estimates from the unigram up."""
    seq = ["^"] * (order - 1) + tokens(text)
    for i in range(order - 1, len(seq)):
        contexts, estimates = [total], [grams[(seq[i],)] / max(total, 1)]
        for n in range(2, order + 1):
            context = tuple(seq[i - n + 1 : i])
            c = starts if set(context) == {"^"} else grams[context]
            contexts.append(c)
            estimates.append(grams[tuple(seq[i - n + 1 : i + 1])] / max(c, 1))
        yield contexts, estimates


def learnt(texts, grams, starts, total, order, floor, rounds=12):
    events = [e for t in texts for e in looked_up(t, grams, starts, total, order)]
    weights = [[0.0] + [0.5] * 63 for _ in range(order)]
    for _ in range(rounds):
        own, every = Counter(), Counter()
        for contexts, estimates in events:
            left = 1.0
            for n in range(order, 0, -1):
                b = 1 + int(math.log2(contexts[n - 1])) if contexts[n - 1] else 0
                p = mixed(contexts[:n], estimates[:n], weights[:n], floor)
                part = left * weights[n - 1][b] * estimates[n - 1] / p
                own[n, b] += part
                every[n, b] += left
                left -= part
        for (n, b), x in every.items():
            if b and x > 0:
                weights[n - 1][b] = min(max(own[n, b] / x, 1e-6), 1 - 1e-6)
    return weights


@pytest.mark.parametrize("order, chunk, group", [(2, 1_000_000, 1_500_000), (2, 150, 40), (3, 400, 100), (1, 200, 50)])
def test_against_plain_counts(spark, order, chunk, group):
    rows = corpus(random.Random(order), 160) + [(900, None), (901, ""), (902, "  "), (None, "W1 W2"), (3, "W1 w2 W1 w2")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    got = lm.score(df, h % 5 != 1, F.floor(h / 5) % 4 == 0, order=order, chunk_tokens=chunk, group_grams=group).collect()
    crc = lambda i: 0 if i is None else zlib.crc32(str(i).encode())
    learn = [t for i, t in rows if crc(i) % 5 != 1]
    deleted = [t for i, t in rows if crc(i) % 5 != 1 and crc(i) // 5 % 4 == 0]
    kept = [t for i, t in rows if crc(i) % 5 != 1 and crc(i) // 5 % 4 != 0]
    assert deleted and kept
    grams, starts = counts(learn, order)
    total = sum(len(tokens(t)) for t in learn)
    v = sum(len(g) == 1 for g in grams)
    floor = 1 / (v + 1)
    kept_grams, kept_starts = counts(kept, order)
    weights = learnt(deleted, kept_grams, kept_starts, sum(len(tokens(t)) for t in kept), order, floor)
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((grams[(w,)] + 0.5) / (total + 0.5 * (v + 1))) for w in own)
        p = sum(math.log10(mixed(c, f, weights, floor)) for c, f in looked_up(t, grams, starts, total, order))
        want.append((i, len(own), sum(grams[(w,)] > 0 for w in own), total, round(base, 6), round(p, 6)))
    found = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_held_out_texts_gain_on_the_base(spark, tmp_path):
    rows = corpus(random.Random(8), 600)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_lm_scoring(spark, str(tmp_path)).where("held_out").collect()
    n = sum(r["n_tokens"] for r in got)
    base, own = (10 ** (-sum(r[c] for r in got) / n) for c in ("base_score", "score"))
    assert own < 0.5 * base


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    for learn in (F.lit(False), F.lit(None).cast("boolean")):
        got = lm.score(df, learn, F.lit(True)).collect()
        assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm.score(df.limit(0), F.lit(True), F.lit(False)).collect() == []
