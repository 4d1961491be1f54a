"""Queries of the order and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import order
from quirefold.plans.registry import query, read

# boxes with a centre, 64 to a page
_CENTRE = ["o_orderkey AS box_id", "o_orderkey div 64 AS page", "CAST((o_custkey * 7) % 900 AS DOUBLE) AS x", "CAST((o_orderkey * 13) % 1300 AS DOUBLE) AS y", "CAST(10 + o_custkey % 40 AS DOUBLE) AS w", "CAST(10 + o_orderkey % 37 AS DOUBLE) AS h"]
_CENTRE_SQL = "SELECT o_orderkey AS box_id, o_orderkey // 64 AS page, ((o_custkey * 7) % 900)::DOUBLE AS x, ((o_orderkey * 13) % 1300)::DOUBLE AS y, (10 + o_custkey % 40)::DOUBLE AS w, (10 + o_orderkey % 37)::DOUBLE AS h FROM orders"
_WAY_SQL = f"SELECT page, CASE WHEN up > across THEN 'vertical' WHEN across > up THEN 'horizontal' WHEN hh > ww THEN 'vertical' ELSE 'horizontal' END AS orientation FROM (SELECT page, count(*) FILTER (h >= 1.3 * w) AS up, count(*) FILTER (w >= 1.3 * h) AS across, max(x + w/2) - min(x - w/2) AS ww, max(y + h/2) - min(y - h/2) AS hh FROM ({_CENTRE_SQL}) GROUP BY page)"
_LINES_SQL = f"""WITH b AS ({_CENTRE_SQL}), r AS (SELECT b.*, orientation, CASE WHEN orientation = 'vertical' THEN -x ELSE y END AS p, CASE WHEN orientation = 'vertical' THEN w ELSE h END AS thick FROM b JOIN ({_WAY_SQL}) USING (page)),
 t AS (SELECT page, quantile_cont(thick, 0.5) / 2 AS tol FROM r GROUP BY page), g AS (SELECT r.*, tol, p - lag(p) OVER (PARTITION BY page ORDER BY p, box_id) AS gap FROM r JOIN t USING (page)),
 l AS (SELECT *, sum(CASE WHEN gap IS NULL OR tol <= 0 OR gap > tol THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY p, box_id) AS line FROM g)
 SELECT page, box_id, line, row_number() OVER (PARTITION BY page, line ORDER BY CASE WHEN orientation = 'vertical' THEN y ELSE x END, CASE WHEN orientation = 'vertical' THEN x ELSE y END, box_id) AS place,
 row_number() OVER (PARTITION BY page ORDER BY line, CASE WHEN orientation = 'vertical' THEN y ELSE x END, CASE WHEN orientation = 'vertical' THEN x ELSE y END, box_id) AS nth FROM l"""


def _centres(spark, d):
    return read(spark, d, "orders").selectExpr(*_CENTRE)


@query("a8_orientation", _WAY_SQL)
def a8(spark, d):
    return order.orientation(_centres(spark, d), "page")


@query("w1_read_lines", _LINES_SQL)
def w1(spark, d):
    return order.read_lines(_centres(spark, d), "page", "box_id").select("page", "box_id", "line", "place", "nth")


@query("w1_read_text", f"SELECT page, string_agg('<' || box_id || '!>', '' ORDER BY nth) AS text FROM ({_LINES_SQL}) GROUP BY page")
def w1_text(spark, d):
    b = _centres(spark, d).withColumn("t", F.expr("concat('<', box_id, '！>')"))
    return order.read_text(b, "page", "box_id", "t")


@query(
    "w2_reading_order",
    f"""WITH RECURSIVE b AS (SELECT page, box_id, x - w/2 AS x1, y - h/2 AS y1, x + w/2 AS x2, y + h/2 AS y2, (x - w/2 + x + w/2)/2 AS cx, (y - h/2 + y + h/2)/2 AS cy FROM ({_CENTRE_SQL})),
    t AS (SELECT page, quantile_cont(y2 - y1, 0.5)/2 AS tol FROM b GROUP BY page), o AS (SELECT b.*, tol, row_number() OVER (PARTITION BY page ORDER BY cy, box_id) AS i FROM b JOIN t USING (page)),
    f AS (SELECT page, i, box_id, cx, cy, 1 AS row, 1 AS n, cy AS mean FROM o WHERE i = 1 UNION ALL SELECT o.page, o.i, o.box_id, o.cx, o.cy, CASE WHEN abs(o.cy - f.mean) > tol THEN f.row + 1 ELSE f.row END, CASE WHEN abs(o.cy - f.mean) > tol THEN 1 ELSE f.n + 1 END, CASE WHEN abs(o.cy - f.mean) > tol THEN o.cy ELSE f.mean + (o.cy - f.mean)/(f.n + 1) END FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1),
    m AS (SELECT *, avg(cy) OVER (PARTITION BY page, row) AS rm FROM f) SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY rm, row, cx DESC, cy, box_id) AS nth FROM m""",
)
def w2(spark, d):
    b = _centres(spark, d).selectExpr("page", "box_id", "x - w/2 AS x1", "y - h/2 AS y1", "x + w/2 AS x2", "y + h/2 AS y2")
    return order.reading_order(b, "page", "box_id", right_to_left=True)


@query("w3_renumber", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations")
def w3(spark, d):
    return order.renumber(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "number")


@query(
    "w3_nudge",
    "SELECT conv_id, turn AS old, CASE WHEN turn = 1 AND lead(turn) OVER w IS NOT NULL THEN lead(turn) OVER w WHEN lag(turn) OVER w = 1 THEN lag(turn) OVER w ELSE turn END AS turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def w3_nudge(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("old"), (F.col("turn") == 1).alias("m"))
    return order.nudge(c, "conv_id", "turn", "m").select("conv_id", "old", "turn")


_LAYER_SQL = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS pos, (l_partkey % 14) - 1 AS layer FROM lineitem"


@query(
    "w4_compact_layers",
    f"""WITH c AS (SELECT *, least(greatest(layer, 1), 10) AS cl FROM ({_LAYER_SQL})), r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY cl) AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY cl, pos) AS paint FROM c)
    SELECT l_orderkey, pos, rank, paint, least(1 + coalesce((SELECT max(s.rank) FROM r s WHERE s.l_orderkey = r.l_orderkey AND s.pos <> r.pos), 0), 10) AS ceiling FROM r""",
)
def w4(spark, d):
    rows = read(spark, d, "lineitem").selectExpr(
        "l_orderkey",
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS pos",
        "(l_partkey % 14) - 1 AS layer",
    )
    return order.compact_layers(rows, "l_orderkey", "pos").select("l_orderkey", "pos", "rank", "paint", "ceiling")


def dialogue(spark, d):
    """Each assistant turn with the user turn before it as a pair; other turns have none."""
    c = read(spark, d, "conversations")
    return c.selectExpr(
        "conv_id", "turn", "role",
        "CASE WHEN role = 'assistant' THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS source",
        "CASE WHEN role = 'assistant' THEN text END AS english",
    )


_WS = "regexp_replace({0}, '\\s+', ' ', 'g')"
_PAIR_SQL = f"""d AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS source, CASE WHEN role = 'assistant' THEN text END AS english FROM conversations),
 p AS (SELECT conv_id, turn, role, substr(trim({_WS.format("source")}), 1, 1000) AS source, substr(trim({_WS.format("english")}), 1, 1000) AS english FROM d WHERE length(trim({_WS.format("source")})) > 0 AND length(trim({_WS.format("english")})) > 0),
 n AS (SELECT d.conv_id, d.turn, p.turn AS pt, p.source, p.english, p.role, row_number() OVER (PARTITION BY d.conv_id, d.turn ORDER BY p.turn DESC) AS back FROM d JOIN p ON p.conv_id = d.conv_id AND p.turn < d.turn)"""


@query(
    "w5_context",
    f"WITH {_PAIR_SQL} SELECT d.conv_id, d.turn, count(pt) AS pairs, md5(coalesce(string_agg(n.source || '>' || n.english || '>' || n.role, '|' ORDER BY pt), '')) AS digest FROM d LEFT JOIN n ON n.conv_id = d.conv_id AND n.turn = d.turn AND back <= 2 GROUP BY d.conv_id, d.turn",
)
def w5(spark, d):
    c = order.context(dialogue(spark, d), "conv_id", "turn", "source", "english", "role", n=2)
    joined = F.array_join(F.transform("context", lambda x: F.concat_ws(">", x["source"], x["english"], x["speaker"])), "|")
    return c.select("conv_id", "turn", F.size("context").cast("long").alias("pairs"), F.md5(joined).alias("digest"))


@query(
    "w6_pack_recent",
    f"""WITH {_PAIR_SQL}, s AS (SELECT *, sum(strlen(source) + strlen(english) + 8) OVER (PARTITION BY conv_id, turn ORDER BY pt DESC) AS spent FROM n WHERE back <= 10)
    SELECT conv_id, turn, count(*) AS kept, max(spent) AS spent, string_agg(CAST(pt AS VARCHAR), ',' ORDER BY pt) AS turns FROM s WHERE spent <= 1500 GROUP BY conv_id, turn""",
)
def w6(spark, d):
    c = dialogue(spark, d)
    with_turn = c.withColumn("role", F.concat_ws(":", "turn", "role"))
    rows = order.context(with_turn, "conv_id", "turn", "source", "english", "role", n=10)
    pairs = rows.select("conv_id", "turn", F.posexplode("context").alias("i", "p"))
    pairs = pairs.withColumn("key", F.struct("conv_id", "turn"))
    kept = order.pack_recent(pairs, "key", "i", F.octet_length("p.source") + F.octet_length("p.english") + 8, 1500)
    turn = F.split("p.speaker", ":")[0].cast("long")
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t.cast("string")), ",")
    return kept.groupBy("conv_id", "turn").agg(F.count("*").alias("kept"), F.max("spent").alias("spent"), turns.alias("turns"))


@query(
    "w7_trim_request",
    f"""WITH {_PAIR_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pt) AS k FROM n WHERE back <= 10),
    r AS (SELECT conv_id, role AS meta_id, string_split(arg_min(text, turn), ' ')[1] AS name_en FROM conversations GROUP BY conv_id, role),
    m AS (SELECT c.conv_id, c.turn, r.meta_id, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY r.meta_id) AS place, strlen(name_en) + strlen(meta_id) AS cost, CASE WHEN c.role = r.meta_id THEN 99 WHEN contains(c.text, meta_id) OR name_en <> '' AND contains(c.text, name_en) THEN 98 ELSE coalesce((SELECT max(k.k) FROM k WHERE k.conv_id = c.conv_id AND k.turn = c.turn AND k.role = r.meta_id), 0) END AS stage FROM conversations c JOIN r USING (conv_id)),
    i AS (SELECT conv_id, turn, k AS stage, 0 AS kind, 0 AS place, strlen(source) + strlen(english) AS cost, NULL AS meta_id FROM k UNION ALL SELECT conv_id, turn, stage, 1, place, cost, meta_id FROM m),
    s AS (SELECT i.*, strlen(c.text) + 128 + sum(cost) OVER (PARTITION BY i.conv_id, i.turn ORDER BY stage, kind, place DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS before FROM i JOIN conversations c USING (conv_id, turn)),
    g AS (SELECT conv_id, turn, count(*) FILTER (kind = 0) AS kept_pairs, coalesce(list(meta_id ORDER BY place) FILTER (kind = 1), []) AS kept_roster, sum(cost) AS held FROM s WHERE before <= 1532 OR stage = 99 GROUP BY conv_id, turn)
    SELECT conv_id * 1000 + turn AS req_id, CASE WHEN ok THEN kept_pairs ELSE 0 END AS kept_pairs, CASE WHEN ok THEN array_to_string(kept_roster, ',') ELSE '' END AS kept_roster, cost, CASE WHEN NOT ok THEN 'does not fit' END AS error
    FROM (SELECT *, strlen(text) + 128 + held AS cost, strlen(text) + 128 + held <= 1532 AS ok FROM g JOIN conversations USING (conv_id, turn))""",
)
def w7(spark, d):
    ctx = order.context(dialogue(spark, d), "conv_id", "turn", "source", "english", "role", n=10)
    c = read(spark, d, "conversations")
    first = c.groupBy("conv_id", F.col("role").alias("meta_id")).agg(F.split(F.min_by("text", "turn"), " ")[0].alias("name_en"))
    row = F.struct("meta_id", "name_en", F.lit(None).cast("string").alias("gender"), F.col("meta_id").alias("alias_en"))
    rosters = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("roster"))
    c = c.join(ctx.withColumnRenamed("context", "pairs").hint("merge"), ["conv_id", "turn"]).join(rosters.hint("merge"), "conv_id")
    req = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"), "text", F.col("role").alias("speaker"), "pairs", "roster")
    return order.trim_request(req).withColumn("kept_roster", F.array_join("kept_roster", ","))


@query("w8_to_ranges", "SELECT l_suppkey, min(l_partkey) AS first, max(l_partkey) AS last FROM (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, g")
def w8(spark, d):
    return order.to_ranges(read(spark, d, "lineitem"), "l_suppkey", "l_partkey")


_CHARS_SQL = "SELECT doc_id, i AS pos, unicode(substr(text, i, 1)) AS cp FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)"
_FACE_SQL = "CASE WHEN cp BETWEEN 32 AND 126 THEN 'primary' WHEN cp BETWEEN 160 AND 255 THEN 'latin' WHEN cp BETWEEN 192 AND 591 THEN 'extended' ELSE 'missing' END"


def characters(docs):
    """One row a character: position from 1 and code point."""
    return docs.select("doc_id", F.posexplode(F.split("text", "")).alias("i", "c")).where("c <> ''").select(
        "doc_id", (F.col("i") + 1).alias("pos"), F.ascii("c").cast("int").alias("cp")
    )


@query(
    "w9_face_runs",
    f"WITH c AS (SELECT doc_id, pos, {_FACE_SQL} AS face FROM ({_CHARS_SQL})), f AS (SELECT *, CASE WHEN face IS DISTINCT FROM lag(face) OVER (PARTITION BY doc_id ORDER BY pos) OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f) SELECT doc_id, run, first(face) AS face, min(pos) AS start, count(*) AS length FROM r GROUP BY doc_id, run",
)
def w9(spark, d):
    faces = {"primary": [(32, 126)], "latin": [(160, 255)], "extended": [(192, 591)]}
    return order.text_face_runs(read(spark, d, "documents"), "doc_id", "text", faces)


@query("w10_recent", "SELECT user_id, event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 QUALIFY place <= 200")
def w10(spark, d):
    return order.recent(read(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 200).select("user_id", "event_id", "place")


@query("w11_latest_attempt", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w11(spark, d):
    return order.latest_attempt(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(
    "w12_first_n_distinct",
    "SELECT p_brand, p_name, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS nth FROM part) WHERE nth = 1) WHERE place <= 5",
)
def w12(spark, d):
    return order.first_n_distinct(read(spark, d, "part"), ["p_brand"], "p_name", "p_partkey", 5).select("p_brand", "p_name", "p_partkey", "place")


@query(
    "w13_even_sample",
    "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey FROM r WHERE n <= 48 OR i IN (SELECT (k * (r.n - 1)) // 47 FROM range(48) t(k))",
)
def w13(spark, d):
    return order.even_sample(read(spark, d, "part"), "p_brand", "p_partkey").select("p_brand", "p_partkey")


_DIMS_SQL = "SELECT p_partkey, p_partkey // 50 AS book, 600 + p_size * 10 AS width, 400 + (p_partkey % 7) * 150 AS height FROM part"


@query(
    "w14_spreads",
    f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY p_partkey) AS i FROM ({_DIMS_SQL})), l AS (SELECT *, i = 1 OR height <= width AS alone FROM a),
    f AS (SELECT book, i, p_partkey, alone, 1 AS spread, 0 AS side, false AS open FROM l WHERE i = 1 UNION ALL SELECT l.book, l.i, l.p_partkey, l.alone, CASE WHEN NOT l.alone AND f.open THEN f.spread ELSE f.spread + 1 END, CASE WHEN NOT l.alone AND f.open THEN 1 ELSE 0 END, NOT l.alone AND NOT f.open FROM f JOIN l ON l.book = f.book AND l.i = f.i + 1)
    SELECT book, p_partkey, spread, side FROM f""",
)
def w14(spark, d):
    p = read(spark, d, "part").selectExpr("p_partkey", "p_partkey div 50 AS book", "600 + p_size * 10 AS width", "400 + (p_partkey % 7) * 150 AS height")
    return order.spreads(p, "book", "p_partkey").select("book", "p_partkey", "spread", "side")


@query(
    "w15_rank_catalogue",
    "SELECT p_name, p_partkey, CASE p_type WHEN 'PROMO' THEN 0 ELSE 1 END AS p0, p_size // 10 AS p1, lower(p_brand) AS family FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part) WHERE nth = 1",
)
def w15(spark, d):
    r = order.rank_catalogue(read(spark, d, "part"), "p_name", [F.expr("CASE p_type WHEN 'PROMO' THEN 0 ELSE 1 END"), F.expr("p_size div 10")], "p_brand", "p_partkey")
    return r.orderBy("sort_key").select("p_name", "p_partkey", "sort_key.p0", "sort_key.p1", "sort_key.family")


@query(
    "k1_search",
    "WITH f AS (SELECT * FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')) SELECT p_partkey, p_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_partkey LIMIT 30 OFFSET 20",
)
def k1(spark, d):
    return order.search(read(spark, d, "part"), " RED ", ["p_name", "p_brand", "p_type"], "p_partkey", 20, 30).select("p_partkey", "p_name", "total")
