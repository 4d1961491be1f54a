"""The ten operators against brute force on small tables with nulls, empty and long texts,
repeated rows, ties, clashing column names, and on empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import embeddings, fingerprints, licenses, mixing, packing, queries, secrets, sharding, simhash, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target double, size string, spans string, fp int"


def awkward():
    rng = random.Random(1)
    words = ["the", "of", "idiot", "naïve", "x", "token", "=", "a1b2c3d4", "--", "日本"]
    texts = [None, "", " ", "a", "  two  spaces ", "tab\there\nline", "x <|endoftext|> y", "foo \n bar", "▁mark ▁", "end ", "é" * 40, "word " * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    texts += [texts[-1], texts[-1], texts[-2] + " more"]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), 1.0, "s", "p", 7) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "no id", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none, rows):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    counted = token_counts.with_token_counts(docs, path)
    assert counted.columns == [*docs.columns, "n_tokens"]
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in counted.collect())
    assert got == sorted((str(r[0]), len(sp.encode(r[1] or ""))) for r in rows)
    assert token_counts.with_token_counts(none, path).count() == 0


def test_licenses(spark):
    mit = (
        "/* Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\n associated documentation files (the \"Software\"), to deal in the Software without restriction, including.\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "Some other line.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    )
    texts = [(1, mit), (2, "x. Licensed under the Apache License, Version 2.0."), (3, "Licensed under CC BY-NC 4.0."), (4, "a licence for nothing"), (5, None), (6, ""), (7, "Released under the MIT License.\n" * 3)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r["doc_id"]: r["licence_scan"] for r in licenses.scan(df).collect()}
    assert [(m["licence"], m["score"]) for m in got[1]["matches"]] == [("MIT", 1.0)]
    assert mit[got[1]["matches"][0]["start"] :].startswith("/* Permission")
    assert [m["licence"] for m in got[2]["matches"]] == ["Apache-2.0"]
    assert [m["licence"] for m in got[3]["matches"]] == ["CC-BY-NC"]
    assert [got[i]["matches"] for i in (4, 5, 6)] == [[], [], []]
    assert len(got[7]["matches"]) == 3
    backwards = "\n".join(reversed(mit.split(".\n")))
    assert all(m[1] < 1 for m in licenses._Book(licenses.SENTENCES, licenses.RULES).match(licenses._Book(licenses.SENTENCES, licenses.RULES).find(backwards)))


def test_license_query_against_lines(spark):
    got = {r["doc_id"]: r["licences"] for r in queries.op2_license_scans(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = {n for n, cue in (("MIT", "Released under the MIT License."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL", "This work is licensed under the GNU General Public License, version 3.")) if cue in r["text"]}
        assert want <= set(got[r["doc_id"]].split(",")), r["doc_id"]


def plain_digest(text, ranks):
    """Windows of 16 bytes, votes and Bloom filters, one step after the other."""
    import xxhash

    raw = text.encode()
    windows = [raw[i : i + 16] for i in range(len(raw) - 15)]

    def rank(w):
        f = fingerprints._F
        top = 4 * 16 * fingerprints._SCALE
        return int(ranks[(top - sum(int(f[n]) for n in collections.Counter(w).values())) * 1000 // top])

    got = [rank(w) for w in windows]
    votes = collections.Counter()
    for start in range(-15 if windows else 0, len(windows)):
        here = [i for i in range(max(0, start), min(len(windows), start + 16))]
        votes[min(here, key=lambda i: (got[i], i))] += 1
    chosen = [i for i in sorted(votes) if votes[i] >= 5 and got[i] < 2047]

    def mixed(w):
        h, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
        for k in (0, 8):
            h ^= int.from_bytes(w[k : k + 8], "little")
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = ((h ^ (h >> 33)) * m) & mask
            h = ((h ^ (h >> 33)) + k + 1) & mask
        return h

    hashes = [mixed(windows[i]) for i in chosen]
    if not hashes and raw:
        hashes = [xxhash.xxh64_intdigest(raw)]
    chain = [[0] * 2048 for _ in range(-(-len(hashes) // 160))]
    for i, h in enumerate(hashes):
        for k in range(5):
            chain[i // 160][h >> (11 * k) & 2047] = 1
    return chain


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    a, b = sorted((a, b), key=lambda c: (len(c), c))
    got = 0.0
    for f in a:
        scores = []
        for g in b:
            common, chance = sum(x & y for x, y in zip(f, g)), sum(f) * sum(g) / 2048
            most = min(sum(f), sum(g))
            floor = chance + 0.3 * (most - chance)
            scores.append((common - floor) / (most - floor))
        got += sum(f) * min(1.0, max(0.0, *scores, -1.0))
    return got / sum(map(sum, a))


def test_digests_and_likeness_step_by_step():
    rng = random.Random(3)
    words = ["the", "rain", "naïve", "é", "日本語", "aaaaaaaaaaaaaaaaaaaaaaaa", "zq81", "\n", "of", "Fe2O3"]
    texts = ["", "a", "é" * 7 + "a", "x" * 15, "y" * 16, "y" * 400] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(12)]
    texts.append(texts[-1][: len(texts[-1]) * 2 // 3] + "another end of it all")
    ranks = np.array(rng.sample(range(1001), 1001), dtype=np.int32)
    ranks[:100] = ranks[991:] = fingerprints.NEVER
    chains = fingerprints.digests([t.encode() for t in texts], ranks)
    for t, c in zip(texts, chains, strict=True):
        assert np.unpackbits(c, axis=1).tolist() == plain_digest(t, ranks), t[:40]
        assert np.array_equal(fingerprints.digest(t, ranks), c)
    for i, a in enumerate(chains):
        for b in chains[i:]:
            want = plain_likeness(np.unpackbits(a, axis=1).tolist(), np.unpackbits(b, axis=1).tolist())
            assert fingerprints.likeness(a, b) == pytest.approx(want) == pytest.approx(fingerprints.likeness(b, a))


def test_selection_in_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    rank = rng.integers(0, 40, 5000).astype(np.int32)
    rank[rng.integers(0, 5000, 300)] = fingerprints.NEVER
    whole = fingerprints.select(rank).tolist()
    data = rng.integers(97, 110, 5000, dtype=np.uint8)
    flat = fingerprints.entropies(data).tolist()
    monkeypatch.setattr(fingerprints, "_STRETCH", 64)
    assert fingerprints.select(rank).tolist() == whole
    assert fingerprints.entropies(data).tolist() == flat


def test_fingerprints(docs, none, rows, spark, monkeypatch):
    many = [(5, f"same id {i % 70}", None) for i in range(400)] + [(None, f"none {i}", None) for i in range(200)]
    table = docs.select("doc_id", "text", "fp").unionAll(spark.createDataFrame(many, "doc_id long, text string, fp int"))
    given = [(r[0], r[1] or "") for r in rows] + [(i, t) for i, t, _ in many]

    def place(r):
        h = spark_hash[r[1]]
        return (0, -r[0], h) if r[0] is not None else (1, 0, h)

    texts = sorted({t for _, t in given})
    spark_hash = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(given, key=place)
    want = collections.Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        want[str(i), len(t), hashlib.sha256(fingerprints.edited(t, nxt).encode()).hexdigest()] += 1
    monkeypatch.setattr(fingerprints, "_GROUP", 2000)
    got = fingerprints.compare(table).collect()
    assert collections.Counter((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    parts = fingerprints.neighbours(table, partitions=12).where("copy = 0").groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 200 and len(parts) > 8
    by_digest = collections.defaultdict(set)
    for r in got:
        by_digest[r["edited_sha256"]].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in by_digest.values())
    assert fingerprints.compare(none).count() == 0
    lone = fingerprints.compare(docs.where("doc_id = 11")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0
    r = queries.op3_fingerprints(spark, SF).collect()
    long = [x for x in r if x["n_chars"] >= 100]
    assert np.mean([x["near_edited"] > x["near_next"] for x in long]) > 0.95


def test_toxicity(docs, none, rows, spark):
    held = {r["doc_id"]: (r["score"], r["held_out"], r["predicted"]) for r in queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(v[1] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= v[0] <= 1 and v[2] == (v[0] >= 0.7) for k, v in held.items())
    out = [(held[k][0], y) for k, y in labels.items() if held[k][1]]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.8
    model = toxicity.fit(["you idiot idiot.", "a fine day"] * 30, [1, 0] * 30, 0.3)
    plain, odd = model.words(["day", "fine"]), model.words(["idiot", "id-iot", "idxiot"])
    assert odd.min() > plain.max()
    scores = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(scores) == len(rows) and all(0 <= r["s"] <= 1 for r in scores)
    assert none.select(toxicity.score(F.col("text"), model)).count() == 0
    nothing = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert docs.select(toxicity.score(F.col("text"), nothing).alias("s")).where("s BETWEEN 0 AND 1").count() == len(rows)


def brute_components(values, linked):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_simhash(docs, none, rows):
    import xxhash

    prints = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    low = {c: min(r[0] for r, k in zip(rows, comp, strict=True) if k == c and r[0] is not None) for c in comp if any(k == c and r[0] is not None for r, k in zip(rows, comp, strict=True))}
    want = sorted((str(r[0]), p, str(low.get(c))) for r, p, c in zip(rows, prints, comp, strict=True))
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and simhash.keep_one(none).count() == 0
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(set(low.values()))


@pytest.mark.parametrize("long_list", [0, 32])
@pytest.mark.parametrize("max_bits", [1, 2])
def test_simhash_links_lose_nothing(spark, long_list, max_bits):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = {b for b in base}
    for _ in range(150):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), max_bits, long_list).collect()
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= max_bits)
    pairs = {(r["src"], r["dst"]) for r in edges} | {(r["dst"], r["src"]) for r in edges}
    assert brute_components(list(range(len(prints))), lambda a, b: (a, b) in pairs) == want


def test_secrets(spark, docs, none, rows):
    hidden = [
        (101, 'é password = "hunter22" and token: abc, Secret="a=b-c"'),
        (102, "AKIA" + "A1" * 9 + " deadbeef" * 4 + " " + "0123456789abcdef" * 2),
        (103, "secret: token: abc123 x"),
        (104, "login: bob near key Zx9Qw8Er7Ty6Ui5Op4As at https://h.example/x"),
        (105, "Zx9Qw8Er7Ty6Ui5Op4As" + " " * 900 + "login: bob"),
        (106, "\ue000\ue001 token = abcdefg"),
    ]
    table = docs.unionByName(spark.createDataFrame(hidden, "doc_id long, text string"), allowMissingColumns=True)
    texts = {str(r[0]): r[1] or "" for r in rows} | {f"h{i}": t for i, t in hidden}
    pats = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]

    def base(t):
        found = [(m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(pats) for m in re.finditer(p, t) if len(m[g]) >= n]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))

    scanned = secrets.scan(table).select("doc_id", secrets.joined(F.col("base")).alias("b"), secrets.joined(F.col("spans")).alias("s")).collect()
    assert sorted(r["b"] for r in scanned) == sorted([base(r[1] or "") for r in rows] + [base(t) for _, t in hidden])
    spans = {(r["doc_id"], r["b"]): r["s"] for r in scanned}
    linked = next(s for (i, _), s in spans.items() if i == 104)
    assert {x.split(":")[0] for x in linked.split(",")} == {"weak_id", "weak_secret", "endpoint"}
    assert all("weak" not in s for (i, b), s in spans.items() if i == 105)  # too far apart
    assert secrets.scan(none).count() == 0
    clean = secrets.redact(table)
    assert clean.columns == table.columns and clean.count() == table.count()
    assert clean.where(F.col("text").contains("hunter22") | F.col("text").contains("abcdefg")).count() == 0
    assert clean.where("text = 'no id'").count() == 1
    assert secrets.redact(none).count() == 0


def test_mixing(spark, docs, none, rows):
    mixed = mixing.mix(docs)
    assert set(docs.columns) | {"size", "source_size", "target", "copies", "taken"} == set(mixed.columns)
    got = mixed.collect()
    assert len(got) == len(rows) and sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}  # documents are taken whole
    assert all(abs(taken[s] - target[s]) <= max(60, 0.02 * target[s], largest[s] / 2) for s in sizes), (taken, target)
    assert mixing.mix(none).count() == 0
    assert mixing.repeat(mixed, docs.columns).count() == sum(r["copies"] for r in got)
    tilted = mixing.mix(docs.withColumn("w", F.when(F.col("doc_id") % 2 == 0, 1.0)), weight_col="w").collect()
    assert len(tilted) == len(rows)


def test_sharding(docs, none, rows, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    narrow = docs.select("doc_id", "text", F.lit(1).alias("shard"))
    got = sharding.shard(narrow, 8).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == sorted(sharding.shard_sizes(len(rows), 8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(str, sharding.shard(narrow, 8).collect())) == sorted(map(str, got))
    assert sharding.shard(none.select("doc_id"), 8).count() == 0


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 9 * 10**9, 1000) for _ in range(4000)]
    assert abs(np.mean(draws) - 250) < 1 and abs(np.var(draws) - 187.5) < 15
    m = sharding.communication_matrix([5, 0, 9], [4, 5, 5], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 9] and m.sum(axis=0).tolist() == [4, 5, 5]


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, length=32, with_ids=True).collect()
    want = collections.Counter((str(r[0]), tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows)
    by_place = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at, found, open_ = 0, collections.Counter(), []
    for r in by_place:
        assert r["sequence_id"] * 32 + r["offset"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["length"]
        open_ += np.frombuffer(r["ids"], "<u4").tolist()
        if r["start"] + r["length"] == r["doc_tokens"]:
            found[(str(r["doc_id"]), tuple(open_))] += 1
            open_ = []
    assert found == want and not open_
    assert packing.pack(none, path).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    for i in range(100, 200):
        x[i] = x[i - 100] + 0.15 * rng.standard_normal(16)
    x[200:230] = x[5] + 0.05 * rng.standard_normal((30, 16))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(300, rows[7][1], 2), (301, rows[7][1], 2), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] * 16, 0), (306, [1.0], 0), (307, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # buckets in several blocks
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, recall=0.9999).collect()}
    good = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    assert all(got[i]["n_links"] <= close[k].sum() for k, (i, _) in enumerate(good))
    assert sum(got[i]["n_links"] for i, _ in good) >= 0.99 * close.sum()
    comp = brute_components(list(range(len(good))), lambda a, b: close[a, b])
    low = {c: min(i for (i, _), k in zip(good, comp, strict=True) if k == c) for c in comp}
    wrong = sum(got[i]["component_id"] != low[c] for (i, _), c in zip(good, comp, strict=True))
    assert wrong <= 3
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(302, 308))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_given_table(spark):
    d = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    x = np.array([v["embedding"] for v in vectors], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = (x @ x.T >= 0.9).sum() - len(x)
    got = sum(r["n_links"] for r in queries.op10_embedding_near_dedup(spark, d).collect())
    assert got <= true and got >= 0.9 * true


def test_pipeline_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("extra"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
        assert out.count() > 0


def test_pipeline_on_given_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    total = out.agg(F.sum("length"), F.max("sequence_id")).first()
    assert 0 <= (total[1] + 1) * 1024 - total[0] < 1024


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 0.99e200]), (3, [1e-200, 1e-200]), (4, [0.9, 0.1]), (5, [1e300, -1e300]), (6, [5e-310, -5e-310])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}
