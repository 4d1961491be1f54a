"""Near copies by five-word shingles: edges are exact, recall is measured, hot groups stay linear."""

import itertools
import random

from pyspark.sql import functions as F

from quirefold.llm import simhash


def made(rng, n, words=300):
    return [f"w{rng.randrange(5000)}" for _ in range(n or words)]


def test_edges_against_all_pairs(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        base = made(rng, rng.randrange(40, 400))
        texts.append(" ".join(base))
        for share in (0.002, 0.01, 0.02, 0.04, 0.08):  # of words changed
            texts.append(" ".join(w if rng.random() > share else f"x{rng.randrange(9999)}" for w in base))
    texts = list(dict.fromkeys([*texts, "", "one", "ONE two", "a b c d e"]))
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {(r["src"], r["dst"]) for r in simhash.similar(df).collect()}
    sets = [set(simhash._shingles(t.lower().encode().split(), 5)) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) if sets[i] or sets[j] else 1.0) >= 0.8}
    assert got <= want and want

    def groups(edges):
        label = list(range(len(texts)))
        for _ in texts:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    a, b = groups(got), groups(want)
    assert sum(x == y for x, y in zip(a, b, strict=True)) >= 0.95 * len(texts)


def test_hot_group_and_awkward_rows(spark):
    rng = random.Random(2)
    base = made(rng, 400)
    hot = [" ".join([*base[:i], f"y{i}", *base[i + 1 :]]) for i in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(hot)] + [(500, None, "s"), (501, "", "s"), (502, " \t ", "s"), (503, "alone and well", "s"), (503, "alone and well", "s"), (504, "ALONE and well", "s"), (None, hot[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    kept = simhash.keep_one_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "500", "503", "None"]
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0
    distinct = docs.where("doc_id < 300").select(F.col("doc_id").alias("node"), "text")
    assert simhash.similar(distinct).count() < 20 * 300  # not the 44,850 pairs of the group


def test_recall_where_unrelated_texts_fill_the_lists(spark):
    """Keys of one byte: each list has some 50 unrelated texts, as with three bytes and 10^9 texts."""
    rng = random.Random(12)
    texts, pairs = [], []
    for _ in range(300):
        base = made(rng, 120)
        other = list(base)
        for i in rng.sample(range(120), 2):
            other[i] = f"x{rng.randrange(9999)}"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(other)]
    texts += [" ".join(made(rng, 30)) for _ in range(12_800 - len(texts))]
    sets = {i: set(simhash._shingles(texts[i].encode().split(), 5)) for p in pairs for i in p}
    alike = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.8}
    assert len(alike) > 250
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(8)
    got = {(r["src"], r["dst"]) for r in simhash.similar(df, width=1).collect()}
    assert got <= alike and len(got) >= 0.9 * len(alike)


def test_keys_widen_with_the_texts():
    assert [simhash.list_width(n) for n in (0, 10**6, 2**24, 2**24 + 1, 10**9, 10**10)] == [3, 3, 3, 4, 4, 5]
    for width, lists in ((3, 128), (4, 512), (5, 2048)):
        places = simhash.list_places(width)
        assert places.shape == (lists, width) and all(len(set(p)) == width for p in places.tolist())
        assert len({tuple(sorted(p)) for p in places.tolist()}) > 0.95 * lists


def test_two_texts_of_one_first_hash_both_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one text"), (2, "another text"), (3, "one text"), (4, "another text")], "doc_id long, text string")
    monkeypatch.setattr(simhash.F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
    kept = simhash.keep_one_similar(docs).collect()
    monkeypatch.undo()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def test_a_long_list_gives_every_near_pair_of_different_groups(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(4)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = []
    for i in range(90):
        sig = list(base)
        for _ in range(rnd.randrange(0, 60)):
            sig[rnd.randrange(4)] ^= 1 << rnd.randrange(64)
        rows.append((1 + i % 2, i, i // 3, [signed(x) for x in sig]))
    differ = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and differ(a[3], b[3]) <= 40}
    members = spark.createDataFrame(rows, "k long, node long, group long, sig array<long>")
    got = [(r["src"], r["dst"]) for r in simhash._blocks_met(members, ["k"], 40, block=16).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100


def test_counts_of_shingles_rule_out_no_pair_that_is_alike(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = made(rng, rng.randrange(30, 300))
        for share in (0.0, 0.02, 0.05, 0.1, 0.3):
            texts.append(" ".join(w if rng.random() >= share else f"x{rng.randrange(9999)}" for w in base))
    texts.append("")
    alike = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if simhash.jaccard(texts[i], texts[j]) >= 0.8}
    rows = [(7, i, i, [0, 0, 0, 0], simhash.shingle_counts(t).tolist()) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "k long, node long, group long, sig array<long>, counts array<int>")
    got = {(r["src"], r["dst"]) for r in simhash._blocks_met(members, ["k"], 60, block=16, similarity=0.8).collect()}
    assert alike <= got and len(alike) > 5
    # all signatures are equal here: what is left of 1830 pairs is left by the counts
    assert len(got) < 4 * len(alike)
