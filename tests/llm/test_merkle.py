"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import string
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirefold.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def built(leaves, arity=8):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def path(levels, i, arity=8):
    out = []
    for level in levels[:-1]:
        at = i - i % arity
        out.append((level[at:i], level[i + 1 : at + arity]))
        i //= arity
    return out


def folded(digest, steps):
    for left, right in steps:
        digest = sha("".join(left) + digest + "".join(right))
    return digest


def wanted(rows, arity=8):
    """Rows of doc_id, source, lang, n_chars, text to their result, as a sorted list."""
    trees = defaultdict(list)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for doc_id, source, lang, n, text in rows:
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        own = leaf(doc_id, source, lang, n, text)
        changed = leaf(doc_id, source, lang, n, text and text.translate(lower)) if tampered else own
        trees[lang].append((doc_id is not None, doc_id or 0, own, changed, doc_id))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {k: built([x[2] for x in sorted(v)], arity) for k, v in trees.items()}
    top = built([subs[k][-1][0] for k in names], arity)
    out = []
    for at, k in enumerate(names):
        for i, (_, _, own, changed, doc_id) in enumerate(sorted(trees[k])):
            steps = path(subs[k], i, arity) + path(top, at, arity)
            end = folded(changed, steps)
            proof = sha("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((doc_id, own, subs[k][-1][0], top[-1][0], proof, end, end == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [64, 1], [65, 7, 0, 1], [513, 3, 8] + [1] * 20])
def test_query_rows(spark, tmp_path, sizes):
    rnd = random.Random(sum(sizes))
    langs = [None, "", "Z", "a", "é", "zz"] + [f"l{i}" for i in range(20)]
    rnd.shuffle(langs)
    rows, doc_id = [], 0
    for lang, n in zip(langs, sizes, strict=False):
        for _ in range(n):
            doc_id += rnd.choice([0, 1, 1, 1, 5])  # ids repeat
            text = rnd.choice([None, "", "Same Text", f"Text ÄB {rnd.random()}"])
            rows.append((rnd.choice([doc_id] * 30 + [None]), rnd.choice([None, "s", "t:1"]), lang, rnd.choice([None, 3]), text))
    rows += rows[:3]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == wanted(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_merkle_manifest(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("arity", [2, 3])
def test_other_arities_and_columns(spark, arity):
    rows = [(i, f"name{i % 3}", "kept", i) for i in range(41)]
    df = spark.createDataFrame(rows, "k long, part string, path string, tree int").withColumn("digest", merkle.leaf(F.col("k")))
    got = merkle.manifest(df, "part", ["k"], arity=arity)
    assert got.columns == ["k", "part", "tree", "digest", "subroot", "root", "path"]
    subs = {p: built([leaf(k) for k, q, _, _ in rows if q == p], arity) for p in ("name0", "name1", "name2")}
    top = built([subs[p][-1][0] for p in sorted(subs)], arity)
    found = got.select("k", "part", "tree", merkle.hex_of(F.col("subroot")).alias("s"), merkle.hex_of(F.col("root")).alias("r"), merkle.hex_of(merkle.folded(F.col("digest"), F.col("path"))).alias("f")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["tree"] == r["k"]
        assert (r["s"], r["r"], r["f"]) == (subs[r["part"]][-1][0], top[-1][0], top[-1][0])
