"""Queries of payloads, sealing, layout, sources and event state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import layout, payload
from quirefold.plans.registry import dealt, query, read

_SCHEMA = {
    "type": "dict",
    "fields": {
        "q": {"source": "text"},
        "langs": {"type": "list", "items": [{"source": "src_lang"}, {"source": "target_lang"}, {"type": "int", "value": 3}]},
        "note": {"type": "string", "value": "<SOURCE_LANG>:<TARGET_LANG>"},
        "opts": {"type": "dict", "fields": {"deep": {"type": "bool", "value": True}, "none": {"type": "null"}, "t": {"type": "float", "value": 0.5}}},
    },
}


def requests(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", "source AS text", "lang AS src_lang", "upper(lang) AS target_lang")


@query(
    "x1_build_payload",
    """SELECT doc_id, '{"q":"' || source || '","langs":["' || lang || '","' || upper(lang) || '",3],"note":"' || lang || ':' || upper(lang) || '","opts":{"deep":true,"none":null,"t":0.5}}' AS payload FROM documents""",
)
def x1(spark, d):
    return requests(spark, d).select("doc_id", payload.build_payload(_SCHEMA).alias("payload"))


@query("x2_encode_pairs", "SELECT doc_id, 'q=' || source || '&langs=' || lang || '&langs=' || upper(lang) || '&langs=3&note=' || lang || '%3A' || upper(lang) AS pairs FROM documents")
def x2(spark, d):
    p = requests(spark, d).select("doc_id", payload.build_payload(_SCHEMA).alias("p"))
    return p.select("doc_id", payload.encode_pairs(F.col("p"), ["q", "langs", "note", "absent"]).alias("pairs"))


@query("x3_collect", """SELECT event_id, concat_ws('|', json_extract_string(props, '$.k'), event_type, 'x') AS found FROM events""")
def x3(spark, d):
    reply = F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"b":["'), F.col("event_type"), F.lit('","x"]}'))
    tree = {"type": "dict", "fields": {"a": {"type": "dict", "fields": {"k": {"source": "text"}, "gone": {"source": "text"}}}, "b": {"type": "list", "items": [{"source": "text", "each": True}]}}}
    found = payload.collect(reply, tree, "text")
    return read(spark, d, "events").select("event_id", F.array_join(F.transform(found, lambda x: F.replace(x, F.lit('"'), F.lit(""))), "|").alias("found"))


@query("x4_flatten_strings", """SELECT event_id, json_extract_string(props, '$.k') || '|' || event_type || '|a "b": c' || chr(92) || '|true|7' AS strings FROM events""")
def x4(spark, d):
    p = F.concat(F.lit('[{"z":'), F.col("props"), F.lit(',"a":["'), F.col("event_type"), F.lit('",null,{"n":"a \\"b\\": c\\\\","b":[true,""]}]},7]'))
    return read(spark, d, "events").select("event_id", F.array_join(payload.flatten_strings(p), "|").alias("strings"))


@query("x5_read_response", "SELECT event_id, json_extract_string(props, '$.k') || event_type AS text, CASE WHEN event_type = 'error' THEN event_type END AS error, event_type || ',' || 'b' AS alternatives FROM events")
def x5(spark, d):
    reply = F.concat(
        F.lit('{"out":['), F.get_json_object("props", "$.k"), F.lit(',"'), F.col("event_type"), F.lit('"],"err":"'),
        F.when(F.col("event_type") == "error", "error").otherwise(""), F.lit('","alt":["'), F.col("event_type"), F.lit('","b","'), F.col("event_type"), F.lit('"]}'),
    )
    each = lambda s: {"type": "list", "items": [{"source": s, "each": True}]}
    tree = {"type": "dict", "fields": {"out": each("text"), "err": {"source": "error"}, "alt": each("alternatives")}}
    r = read(spark, d, "events").select("event_id", payload.read_response(reply, tree).alias("r"))
    return r.select("event_id", "r.text", "r.error", F.array_join("r.alternatives", ",").alias("alternatives"))


@query("x6_x7_seal_and_open", "SELECT c_custkey, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance, c_mktsegment AS segment, false AS wrong FROM customer")
def x6(spark, d):
    c = read(spark, d, "customer").selectExpr("c_custkey", "c_name AS name", "CAST(c_acctbal AS STRING) AS balance", "c_mktsegment AS segment")
    new, old = (F.encode(F.substring(F.sha2(F.concat(F.lit(x), "segment"), 256), 1, 32), "UTF-8") for x in "ab")
    sealed = payload.seal(c, ["name", "balance"], old)
    opened = sealed.select(
        "c_custkey", payload.open_sealed(sealed, "name", [new, old], 3600).alias("name"), payload.open_sealed(sealed, "balance", [new, old]).alias("balance"),
        "segment", payload.open_sealed(sealed, "name", [new]).isNotNull().alias("wrong"),
    )
    return opened


@query(
    "x7_open_alternatives",
    """SELECT o_custkey, string_agg(word, ',' ORDER BY first) AS words FROM (SELECT o_custkey, o_orderpriority AS word, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL) GROUP BY o_custkey
    UNION ALL SELECT o_custkey, '' FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 5 <> 0) = 0""",
)
def x7(spark, d):
    """A customer's alternatives under two keys, equal words sealed each for itself, a fifth of them under a lost key."""
    key = lambda x: F.encode(F.substring(F.sha2(F.concat(F.lit(x), F.col("o_custkey").cast("string")), 256), 1, 32), "UTF-8")
    used = F.when(F.col("o_orderkey") % 5 == 0, key("lost")).when(F.col("o_orderkey") % 2 == 0, key("old")).otherwise(key("new"))
    o = read(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderpriority AS word")
    sealed = payload.seal(o, ["word"], used).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "word"))).alias("a"))
    sealed = sealed.select("o_custkey", F.transform("a", lambda x: x["word"]).alias("a"))
    return sealed.select("o_custkey", F.array_join(payload.open_alternatives(sealed, "a", [key("new"), key("old")], 3600), ",").alias("words"))


@query(
    "x8_render_context",
    "SELECT doc_id, '[character] Name: ' || source || ' (' || lang || ')' || chr(10) || 'o = ' || lang || chr(10) || '1. [' || source || ']: s -> e' || chr(10) || '2. t -> f' AS text FROM documents",
)
def x8(spark, d):
    ctx = F.expr("array(struct('s' AS source, 'e' AS english, source AS speaker), struct('t' AS source, 'f' AS english, CAST(NULL AS STRING) AS speaker))")
    roster = F.expr("array(struct(source AS name_en, lang AS name_ja, CAST(NULL AS STRING) AS gender))")
    gloss = F.expr("array(struct('o' AS original, lang AS english))")
    return read(spark, d, "documents").select("doc_id", payload.render_context(ctx, roster, gloss).alias("text"))


def _pieces(text: str, room: str) -> str:
    """SQL list of {n, gap}: lengths of the pieces of a text's words; too wide ones are cut after inner hyphens."""
    words = f"list_filter(string_split_regex(regexp_replace({text}, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"
    cut = "regexp_replace(regexp_replace(x, '([^-])-([^-])', '\\1-' || chr(1) || '\\2', 'g'), '([^-\\x01])-([^-\\x01])', '\\1-' || chr(1) || '\\2', 'g')"
    parts = f"CASE WHEN length(x) > {room} THEN string_split({cut}, chr(1)) ELSE [x] END"
    return f"flatten(list_transform({words}, lambda x: list_transform({parts}, lambda y, i: {{'t': y, 'gap': i = 1}})))"


def _wrapped(source: str, keys: str, room: str) -> str:
    """SQL for CTEs w and f: the greedy fold over the pieces ``ps`` of ``source``; f has the state after piece i."""
    fits = f"length(line) + CAST(ps[i + 1].gap AS INT) + length(ps[i + 1].t) <= {room}"
    joined = "line || CASE WHEN ps[i + 1].gap THEN ' ' ELSE '' END || ps[i + 1].t"
    return f"""w AS ({source}),
    f AS (SELECT {keys}, ps, {room} AS room, 1 AS i, ps[1].t AS line, 1 AS n, length(ps[1].t) AS longest FROM w WHERE len(ps) > 0
      UNION ALL SELECT {keys}, ps, room, i + 1, CASE WHEN {fits} THEN {joined} ELSE ps[i + 1].t END, CASE WHEN {fits} THEN n ELSE n + 1 END,
        greatest(longest, length(CASE WHEN {fits} THEN {joined} ELSE ps[i + 1].t END)) FROM f WHERE i < len(ps)),
    e AS (SELECT {keys}, any_value(room) AS room, arg_max(n, i) AS lines, arg_max(longest, i) AS longest, arg_max(line, i) AS last FROM f GROUP BY {keys})"""


_L1 = _wrapped(f"SELECT conv_id, turn, 38 AS room, {_pieces('text', '38')} AS ps FROM conversations", "conv_id, turn", "room")


@query("l1_wrap", f"WITH RECURSIVE {_L1} SELECT conv_id, turn, lines, longest, last FROM e")
def l1(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("text")).where("trim(text) <> ''")
    lines = c.withColumn("l", layout.wrap(F.col("text"), F.lit(40.0)))
    return lines.select("conv_id", "turn", F.size("l").alias("lines"), F.array_max(F.transform("l", lambda s: F.length(s))).alias("longest"), F.element_at("l", -1).alias("last"))


@query("l2_block_size", "SELECT page_id, greatest(length(url) * 0.5 * s, 2 * 0.5 * s) AS width, (s + greatest(1, floor(0.14 * s + 0.5))) + s AS height FROM (SELECT page_id, url, 6 + page_id % 40 AS s FROM pages)")
def l2(spark, d):
    p = read(spark, d, "pages").select("page_id", layout.block_size(F.array(F.col("url"), F.lit("ab")), 6 + F.col("page_id") % 40).alias("b"))
    return p.select("page_id", "b.width", "b.height")


def names(spark, d):
    return dealt(read(spark, d, "part"), "p_partkey").selectExpr("p_partkey", "p_partkey div 50 AS page", "concat(p_name, ' ', p_type, '-', p_brand) AS text", "CAST(20 + p_size * 3 AS DOUBLE) AS w", "CAST(10 + p_partkey % 60 AS DOUBLE) AS h")


_ROOM = "greatest(w / (0.5 * size) - 2, 1)"
_FITS = _wrapped(
    f"SELECT p_partkey, page, size, w, h, {_ROOM} AS room, {_pieces('text', _ROOM)} AS ps FROM (SELECT p_partkey, p_partkey // 50 AS page, p_name || ' ' || p_type || '-' || p_brand AS text, 20 + p_size * 3 AS w, 10 + p_partkey % 60 AS h FROM part), range(6, 73) t(size)",
    "p_partkey, page, size, w, h",
    "room",
)
_FITS += """, g AS (SELECT p_partkey, page, size, longest * 0.5 * size <= w AND (lines - 1) * (size + greatest(1, floor(0.14 * size + 0.5))) + size <= h AS fits FROM e)"""


@query(
    "k2_fit_size",
    f"""WITH RECURSIVE {_FITS}, b AS (SELECT p_partkey, 6 AS low, 72 AS high, NULL::BIGINT AS best FROM part
      UNION ALL SELECT b.p_partkey, CASE WHEN fits THEN g.size + 1 ELSE low END, CASE WHEN fits THEN high ELSE g.size - 1 END, CASE WHEN fits THEN g.size ELSE best END FROM b JOIN g ON g.p_partkey = b.p_partkey AND g.size = (low + high) // 2 WHERE low <= high)
    SELECT p_partkey, best AS size FROM b WHERE low > high""",
)
def k2(spark, d):
    return layout.fit_size(names(spark, d), "p_partkey", "text", "w", "h")


@query("l3_overflow_report", f"WITH RECURSIVE {_FITS} SELECT page, count(*) AS texts, count_if(NOT fits) AS overflow FROM g WHERE size = 6 GROUP BY page")
def l3(spark, d):
    return layout.overflow_report(names(spark, d), "p_partkey", "page", "text", "w", "h")
