"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirefold.llm import (
    embeddings,
    fingerprints,
    licenses,
    lm,
    merkle,
    mixing,
    packing,
    periods,
    secrets,
    sharding,
    simhash,
    token_counts,
    toxicity,
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, tokenizer_path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        token_counts.utf8_bytes(F.col("text")).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs)
    matches = F.col("licence_scan.matches")
    return found.select(
        "doc_id",
        F.array_join(F.col("licence_scan.sentences"), ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["licence"]))), ",").alias("licences"),
        F.array_join(
            F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.concat_ws("-", m["licence"], m["version"])))), ","
        ).alias("versions"),
        F.size(matches).cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform(matches, lambda m: m["score"])), F.lit(0.0)).alias("best_score"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        (~toxicity.may_learn(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, seed=42, max_bits=2)
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text"))
    mixed = mixing.mix(sized, size_col="words", weights=(3, 1, 2), share=1.5, most=2.0)  # the hash tells texts apart
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    placed = sharding.shard(narrow, shards=8, keys=["doc_id", "text_crc32"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), length=1024, end_id=0)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


def _id_crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@F.pandas_udf(StringType())
def repeating_tail(texts: pd.Series, hashes: pd.Series) -> pd.Series:
    """op11's texts: where the hash is divisible by 10, word i from a on is word a + (i - a) % p."""

    def changed(text: str | None, h: float) -> str | None:
        if text is None or h != h or h % 10:
            return text
        words, g = text.encode().split(), int(h) // 10
        if words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
        return b" ".join(words).decode()

    return pd.Series([changed(x, h) for x, h in zip(texts, hashes, strict=True)], dtype=object)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", repeating_tail(F.col("text"), _id_crc().cast("double")).alias("text"))
    found = periods.scan(docs)  # ships the package, which the tail needs too
    runs = F.col("periodic.runs")

    def more(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digested = found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.aggregate(runs, none, more).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed"), 256).alias("collapsed_sha256"),
    )
    return digested.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")

    def digest(text: Column) -> Column:
        return merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = F.when(_id_crc() % 3 == 0, digest(F.translate("text", upper, lower)))
    slim = docs.select("doc_id", "lang", digest(F.col("text")).alias("digest"), changed.alias("changed"))
    proved = merkle.manifest(slim, "lang", ["doc_id"], arity=8)
    folded = merkle.hex_of(merkle.folded(F.coalesce("changed", "digest"), F.col("path")))
    out = proved.select(
        "doc_id",
        merkle.hex_of(F.col("digest")).alias("leaf"),
        merkle.hex_of(F.col("subroot")).alias("subroot"),
        merkle.hex_of(F.col("root")).alias("root"),
        F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.coalesce(_id_crc(), F.lit(0))
    learnt = crc % 5 != 1
    found = lm.score(docs, learnt, F.floor(crc / 5) % 20 == 0, order=2)
    return found.select("doc_id", (crc % 5 == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scans": op2_license_scans,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_secret_scans": op6_secret_scans,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lm_scoring": op13_lm_scoring,
}

def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of ASCII ``text``, bit by bit."""
    octet = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    octets = f"list_transform(string_split({text}, ''), lambda d: ord(d)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: {octet}), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


_TAIL = "CASE WHEN i < a THEN i ELSE a + (i - a) % p END"

ORACLES: dict[str, str] = {
    "op11_periodic_runs": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
    e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), f AS (SELECT *, g % greatest(n, 1) AS a FROM e), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
    t AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 THEN w[{_TAIL} + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
    g AS MATERIALIZED (SELECT doc_id, n, i, hash(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS 7 PRECEDING)) AS gram FROM t QUALIFY i >= 7),
    q AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i < x.i WHERE 3 * (x.i - y.i) <= x.n),
    m AS (SELECT doc_id, q, min(i) AS i, count(*) + 7 AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS run FROM q) GROUP BY doc_id, q, run),
    r AS MATERIALIZED (SELECT doc_id, i - 7 - q AS start, m + q AS length, min(q) AS period FROM m WHERE m + q >= greatest(24, 3 * q) GROUP BY doc_id, i - 7 - q, m + q),
    s AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length::DOUBLE / period, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op12_merkle_manifest": f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS held, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
      FROM (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed, {_crc32_sql("doc_id::VARCHAR")} AS crc FROM documents)),
    names AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM leaves)),
    up AS (SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves l JOIN names m ON l.lang IS NOT DISTINCT FROM m.lang
      UNION ALL SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, idx // 8, n),
    tops AS MATERIALIZED (SELECT tree, digest FROM up WHERE n = 1),
    over_ AS (SELECT 0 AS level, tree AS idx, trees AS n, digest FROM tops JOIN names USING (tree)
      UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM over_ WHERE n > 1 GROUP BY level, idx // 8, n),
    steps AS MATERIALIZED (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') || '|' || coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS step
      FROM (SELECT * FROM up UNION ALL SELECT -1, * FROM over_) a JOIN (SELECT * FROM up UNION ALL SELECT -1, * FROM over_) b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL),
    high AS (SELECT tree, coalesce(list(step ORDER BY level) FILTER (step IS NOT NULL), []) AS path FROM (SELECT m.tree, s.level, s.step FROM names m LEFT JOIN steps s ON s.tree = -1 AND s.idx = m.tree // (8 ** s.level)::BIGINT) GROUP BY tree),
    paths AS (SELECT tree, idx, coalesce(list(step ORDER BY level) FILTER (step IS NOT NULL), []) AS path FROM (SELECT m.tree, l.idx, s.level, s.step FROM leaves l JOIN names m ON l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN steps s ON s.tree = m.tree AND s.idx = l.idx // (8 ** s.level)::BIGINT) GROUP BY tree, idx),
    proved AS (SELECT l.*, m.tree, list_concat(p.path, h.path) AS path FROM leaves l JOIN names m ON l.lang IS NOT DISTINCT FROM m.lang JOIN paths p ON p.tree = m.tree AND p.idx = l.idx JOIN high h ON h.tree = m.tree),
    ends AS (SELECT *, list_reduce(list_concat([held], path), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root FROM proved)
    SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified FROM ends e JOIN tops t USING (tree), (SELECT digest FROM over_ WHERE n = 1) r""",
}
