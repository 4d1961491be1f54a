"""Groups of near copies are carried from round to round: each edge is linked once."""

import itertools
import random

from quirefold.llm import simhash


def test_regrouped_is_what_all_edges_give(spark):
    rng = random.Random(5)
    old = [(rng.randrange(80), rng.randrange(80)) for _ in range(40)]
    new = [(rng.randrange(120), rng.randrange(120)) for _ in range(30)] + [(200, 201), (201, 202)]
    frames = [spark.createDataFrame(e, "src long, dst long") for e in (old, new)]
    found = simhash.regrouped(simhash.connected_components(frames[0]), frames[1].where("src <> dst"))
    want = simhash.connected_components(frames[0].unionAll(frames[1]))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_each_edge_is_linked_once(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(5):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [" ".join(w if rng.random() > 0.002 else f"x{rng.randrange(9999)}" for w in base) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    given, made, plain, groups = [], [], simhash.connected_components, simhash.similar_groups

    def counted(edges, *by):
        given.append(edges.count())
        return plain(edges, *by)

    def watched(*args):
        out = groups(*args)
        made.append(out[0].count())
        return out

    monkeypatch.setattr(simhash, "connected_components", counted)
    monkeypatch.setattr(simhash, "similar_groups", watched)
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and simhash.jaccard(rows[i], rows[j]) >= 0.8:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()} == set(label)
    assert sum(given) == sum(made) > 0


def test_pairs_of_a_group_are_looked_up_once_and_few_are_left(spark, monkeypatch):
    """Texts whose pairs lie on both sides of the similarity: rows that the look-ups of groups make."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for _ in range(240):
        words = list(base)
        for i in rng.sample(range(200), rng.choice((2, 3))):
            words[i] = f"x{rng.randrange(9999)}"
        rows.append(" ".join(words))
    made, plain = [], simhash._group_of

    def watched(pairs, found, node, out):
        if node in ("src", "ca"):
            made.append(pairs.count())
        return plain(pairs, found, node, out)

    monkeypatch.setattr(simhash, "_group_of", watched)
    texts = spark.createDataFrame(list(enumerate(rows)), "node long, text string")
    found = {r["node"]: r["component"] for r in simhash.similar_groups(texts)[1].collect()}
    sigs = [simhash.signature(t) for t in rows]
    near = sum(sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True)) <= 60 for a, b in itertools.combinations(sigs, 2))
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and simhash.jaccard(rows[i], rows[j]) >= 0.8:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = [found.get(i, i) for i in range(len(rows))]
    assert all(label[i] == label[g] for i, g in enumerate(got)) and sum(x == y for x, y in zip(got, label, strict=True)) >= 0.95 * len(rows)
    assert made[0] <= near
    assert sum(made[1:]) < 0.2 * made[0], made
