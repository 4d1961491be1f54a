"""Queries of the aggregations, tilings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import aggregate as A
from quirefold.operators import strokes
from quirefold.plans.registry import dealt, query, read

_PX = ["l_suppkey AS g_id", "CAST(l_partkey % 256 AS INT) AS r", "CAST((l_partkey * 3 + l_linenumber) % 256 AS INT) AS g", "CAST((CAST(l_quantity AS INT) * 5) % 256 AS INT) AS b", "l_linenumber"]
_PX_SQL = "SELECT l_suppkey AS g_id, (l_partkey % 256)::INT AS r, ((l_partkey * 3 + l_linenumber) % 256)::INT AS g, ((l_quantity::INT * 5) % 256)::INT AS b, l_linenumber FROM lineitem"


def px(spark, d):
    return read(spark, d, "lineitem").selectExpr(*_PX)


@query(
    "a1_modal_colour",
    f"""WITH p AS (SELECT *, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS k FROM ({_PX_SQL})), c AS (SELECT g_id, k, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT g_id, k FROM c QUALIFY row_number() OVER (PARTITION BY g_id ORDER BY n DESC, k) = 1)
    SELECT g_id, round_even(quantile_cont(r, 0.5), 0)::INT AS r, round_even(quantile_cont(g, 0.5), 0)::INT AS g, round_even(quantile_cont(b, 0.5), 0)::INT AS b, count(*) AS n FROM p JOIN t USING (g_id, k) GROUP BY g_id""",
)
def a1(spark, d):
    return A.modal_colour(px(spark, d), "g_id")


@query("a2_dominant_colour", f"SELECT g_id, r, g, b, n FROM (SELECT g_id, r, g, b, count(*) AS n FROM ({_PX_SQL}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY g_id ORDER BY n DESC, r, g, b) = 1")
def a2(spark, d):
    return A.dominant_colour(px(spark, d), "g_id")


def otsu_sql(table, by, v):
    return f"""WITH h AS (SELECT {by}, floor({v})::INT AS v, count(*) AS n FROM ({table}) GROUP BY ALL),
    c AS (SELECT {by}, v, sum(n) OVER o AS n0, sum(n * v) OVER o AS s0, sum(n) OVER w AS a, sum(n * v) OVER w AS s, sum(n * v * v) OVER w AS q FROM h WINDOW o AS (PARTITION BY {by} ORDER BY v), w AS (PARTITION BY {by})),
    b AS (SELECT *, CASE WHEN a > n0 THEN n0::DOUBLE * (a - n0) * pow(s0 / n0 - (s - s0) / (a - n0), 2) ELSE 0 END AS bt FROM c),
    t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY round(bt, 6) DESC, v) = 1)
    SELECT {by}, v AS threshold, CASE WHEN q / a - pow(s / a, 2) > 0 AND bt > 0 THEN bt / (a::DOUBLE * a * (q / a - pow(s / a, 2))) ELSE 0 END AS separability, (a - n0) / a AS share, a AS n FROM t"""


@query("a3_otsu", f"SELECT g_id, threshold, round(separability, 6) AS separability, round(share, 6) AS share, n FROM ({otsu_sql(_PX_SQL, 'g_id', 'r')})")
def a3(spark, d):
    return A.otsu(px(spark, d), "g_id", "r").select("g_id", "threshold", F.round("separability", 6).alias("separability"), F.round("share", 6).alias("share"), "n")


# A crop of 24 by 20 pixels for each part: a bar of ink, in some with an outline, in one of seven kinds
# without a zone and in another a slope of greys.
_K = "p_partkey % 7"
_BAR = "(x BETWEEN 6 AND 7 + p_size % 9 AND y BETWEEN 3 AND 16)"
_EDGE = "(x = 6 OR x = 7 + p_size % 9 OR y = 3 OR y = 16)"
_STROKE_PX = [
    "p_partkey AS g_id", "x", "y",
    f"CAST(CASE WHEN {_K} = 6 THEN x * 10 WHEN {_BAR} AND {_EDGE} AND p_size % 3 > 0 THEN 200 WHEN {_BAR} THEN 10 + {_K} ELSE 240 + (x * y) % 8 END AS INT) AS r",
    f"CAST(CASE WHEN {_K} = 6 THEN x * 10 WHEN {_BAR} AND {_EDGE} AND p_size % 3 = 1 THEN 30 WHEN {_BAR} THEN 20 ELSE 240 + (p_partkey + x) % 3 END AS INT) AS g",
    f"CAST(CASE WHEN {_K} = 6 THEN x * 10 WHEN {_BAR} THEN 30 ELSE 230 + y % 2 END AS INT) AS b",
    f"CASE WHEN {_K} = 5 THEN 'rest' WHEN x BETWEEN 4 AND 17 AND y BETWEEN 2 AND 17 THEN 'zone' WHEN {_K} = 3 THEN 'rest' WHEN x BETWEEN 2 AND 19 THEN 'ring' ELSE 'rest' END AS zone",
]
_STROKE_SQL = f"SELECT {', '.join(_STROKE_PX)} FROM part, range(24) xs(x), range(20) ys(y)"


def _lab_sql(c):
    """SQL for the whole lightness, a and b of sRGB columns ``c``r, ``c``g, ``c``b, on a scale of 255."""
    lin = [f"(CASE WHEN {c}{k} / 255 <= 0.04045 THEN {c}{k} / 255 / 12.92 ELSE pow(({c}{k} / 255 + 0.055) / 1.055, 2.4) END)" for k in "rgb"]
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))
    t = [f"(({u}::DOUBLE * {lin[0]} + {v}::DOUBLE * {lin[1]} + {w}::DOUBLE * {lin[2]}) / {white})" for u, v, w, white in rows]
    x, y, z = (f"(CASE WHEN {k} > 216::DOUBLE / 24389 THEN cbrt({k}) ELSE ({k} * 24389 / 27 + 16) / 116 END)" for k in t)
    return [f"round(round({e}, 6))" for e in (f"(116 * {y} - 16) * 2.55", f"500 * ({x} - {y}) + 128", f"200 * ({y} - {z}) + 128")]


def _named_lab(c, name):
    return ", ".join(f"{e} AS {name}_{k}" for e, k in zip(_lab_sql(c), "lab", strict=True))


def _modal_sql(rows):
    """SQL for the modal colour of each group of ``rows``."""
    return f"""SELECT g_id, round_even(quantile_cont(r, 0.5), 0)::INT AS r, round_even(quantile_cont(g, 0.5), 0)::INT AS g, round_even(quantile_cont(b, 0.5), 0)::INT AS b
      FROM (SELECT *, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS k FROM {rows}) JOIN (SELECT g_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS k FROM {rows} GROUP BY g_id, k QUALIFY row_number() OVER (PARTITION BY g_id ORDER BY count(*) DESC, k) = 1) USING (g_id, k) GROUP BY g_id"""


_MEDIANS = ", ".join(f"round_even(quantile_cont({c}, 0.5), 0)::INT AS {c}" for c in "rgb")


@query(
    "a4_region_colours",
    f"""WITH crop AS MATERIALIZED ({_STROKE_SQL}),
    size AS (SELECT g_id, count(*) FILTER (zone = 'zone') AS zn, count(*) FILTER (zone = 'ring') AS rn, count(*) FILTER (zone <> 'zone') AS other FROM crop GROUP BY g_id),
    paper AS (SELECT c.* FROM crop c JOIN size USING (g_id) WHERE zn < 64 OR (rn < 64 AND other < 64) OR (rn >= 64 AND zone = 'ring') OR (rn < 64 AND other >= 64 AND zone <> 'zone')),
    plate AS MATERIALIZED (SELECT *, {_named_lab('', 'p')} FROM ({_modal_sql('paper')})),
    sample AS MATERIALIZED (SELECT *, round(sqrt(pow(c_l - p_l, 2) + pow(c_a - p_a, 2) + pow(c_b - p_b, 2)), 6) AS away
      FROM (SELECT c.*, {_named_lab('c.', 'c')}, p_l, p_a, p_b FROM crop c JOIN size USING (g_id) JOIN plate p USING (g_id) WHERE zn < 64 OR zone = 'zone')),
    split AS ({otsu_sql("SELECT g_id, least(away, 255) AS away FROM sample", "g_id", "away")}),
    body AS MATERIALIZED (SELECT s.* FROM sample s JOIN split t USING (g_id) WHERE separability >= 0.88 AND n >= 40 AND away > greatest(18, threshold)
      QUALIFY count(*) OVER (PARTITION BY s.g_id) >= 40 AND count(*) OVER (PARTITION BY s.g_id) / n BETWEEN 0.004 AND 0.72),
    hole AS (SELECT c.g_id, c.x, c.y FROM crop c ANTI JOIN body USING (g_id, x, y)),
    deep AS MATERIALIZED (SELECT b.*, d.depth FROM body b JOIN (SELECT b.g_id, b.x, b.y, sqrt(min(pow(b.x - h.x, 2) + pow(b.y - h.y, 2))) AS depth FROM body b JOIN hole h USING (g_id) GROUP BY ALL) d USING (g_id, x, y)),
    radius AS (SELECT g_id, round(quantile_cont(depth, 0.9), 9) AS radius FROM deep GROUP BY g_id),
    core AS (SELECT g_id, {_MEDIANS} FROM deep JOIN radius USING (g_id) WHERE round(depth, 9) >= greatest(1, round(0.6 * radius, 9)) GROUP BY g_id HAVING count(*) >= 8),
    whole AS (SELECT g_id, {_MEDIANS} FROM body GROUP BY g_id),
    ink AS MATERIALIZED (SELECT *, {_named_lab('', 'i')} FROM (FROM core UNION ALL FROM whole ANTI JOIN core USING (g_id))),
    edge AS MATERIALIZED (SELECT d.g_id, r, g, b FROM deep d JOIN radius USING (g_id) WHERE depth <= 1 AND radius >= 2 QUALIFY count(*) OVER (PARTITION BY d.g_id) >= 40),
    line AS (SELECT *, CASE WHEN (i_l - p_l) ^ 2 + (i_a - p_a) ^ 2 + (i_b - p_b) ^ 2 < 1e-6 THEN 0 ELSE greatest(0, least(1, ((e_l - p_l) * (i_l - p_l) + (e_a - p_a) * (i_a - p_a) + (e_b - p_b) * (i_b - p_b)) / ((i_l - p_l) ^ 2 + (i_a - p_a) ^ 2 + (i_b - p_b) ^ 2))) END AS t
      FROM (SELECT g_id, r, g, b, {_named_lab('', 'e')} FROM ({_modal_sql('edge')})) JOIN (SELECT g_id, p_l, p_a, p_b FROM plate) USING (g_id) JOIN (SELECT g_id, i_l, i_a, i_b FROM ink) USING (g_id)),
    rim AS (SELECT g_id, r, g, b FROM line WHERE round(sqrt((e_l - p_l - t * (i_l - p_l)) ^ 2 + (e_a - p_a - t * (i_a - p_a)) ^ 2 + (e_b - p_b - t * (i_b - p_b)) ^ 2), 6) > 18)
    SELECT p.g_id, p.r AS plate_r, p.g AS plate_g, p.b AS plate_b, i.r AS ink_r, i.g AS ink_g, i.b AS ink_b, m.r AS rim_r, m.g AS rim_g, m.b AS rim_b
    FROM plate p LEFT JOIN ink i USING (g_id) LEFT JOIN rim m USING (g_id)""",
)
def a4(spark, d):
    crop = dealt(read(spark, d, "part"), "p_partkey").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("x"))
    crop = crop.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("y")).selectExpr(*_STROKE_PX)
    c = strokes.region_colours(crop, "g_id")
    return c.select("g_id", *(F.col(f"{part}.{k}").alias(f"{part}_{k}") for part in ("plate", "ink", "rim") for k in "rgb"))


@query(
    "a5_stats",
    "SELECT l_suppkey, quantile_cont(l_extendedprice, 0.025) AS p2_5, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.975) AS p97_5 FROM lineitem GROUP BY l_suppkey",
)
def a5(spark, d):
    return A.stats(read(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")


_FLAT_SQL = "SELECT l_orderkey % 5000 AS g_id, (200 + l_partkey % (3 + l_orderkey % 12))::INT AS r, (190 + l_suppkey % (2 + l_orderkey % 9))::INT AS g, (100 + l_linenumber)::INT AS b FROM lineitem"


@query(
    "a6_flat_fill_value",
    f"""WITH s AS (SELECT g_id, count(*) AS n, round(greatest(quantile_cont(r, 0.975) - quantile_cont(r, 0.025), quantile_cont(g, 0.975) - quantile_cont(g, 0.025), quantile_cont(b, 0.975) - quantile_cont(b, 0.025)), 9) AS spread, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM ({_FLAT_SQL}) GROUP BY g_id)
    SELECT g_id, CASE WHEN n >= 12 AND spread <= 8 THEN round_even(r, 0)::INT END AS r, CASE WHEN n >= 12 AND spread <= 8 THEN round_even(g, 0)::INT END AS g, CASE WHEN n >= 12 AND spread <= 8 THEN round_even(b, 0)::INT END AS b FROM s""",
)
def a6(spark, d):
    rows = read(spark, d, "lineitem").selectExpr("l_orderkey % 5000 AS g_id", "CAST(200 + l_partkey % (3 + l_orderkey % 12) AS INT) AS r", "CAST(190 + l_suppkey % (2 + l_orderkey % 9) AS INT) AS g", "CAST(100 + l_linenumber AS INT) AS b")
    return A.flat_fill_value(rows, "g_id")


@query(
    "a7_robust_median",
    """WITH g AS (SELECT l_suppkey, l_extendedprice AS v FROM lineitem WHERE l_extendedprice > 0), m AS (SELECT l_suppkey, quantile_cont(v, 0.5) AS m FROM g GROUP BY 1), x AS (SELECT g.*, m, abs(v - m) AS dv FROM g JOIN m USING (l_suppkey)), q AS (SELECT l_suppkey, quantile_cont(dv, 0.5) AS mad FROM x GROUP BY 1)
    SELECT l_suppkey, quantile_cont(v, 0.5) AS height, count(*) AS n FROM x JOIN q USING (l_suppkey) WHERE dv <= greatest(3 * 1.4826 * mad, 0.2 * m) GROUP BY 1""",
)
def a7(spark, d):
    return A.robust_median(read(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")


@query(
    "a9_tally",
    "SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type = 'view') AS read, count(*) FILTER (event_type = 'click') AS blank, count(*) FILTER (event_type = 'purchase') AS translated, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') = 0 AS clean FROM events GROUP BY user_id",
)
def a9(spark, d):
    kind = lambda k: F.col("event_type") == k
    return A.tally(read(spark, d, "events"), "user_id", kind("view"), kind("click"), kind("purchase"), kind("error"))


_ENTRY = ["o_orderkey AS entry_id", "o_orderkey div 64 AS page", "CAST(o_orderkey % 6 AS INT) AS points", "o_orderstatus AS method", "CAST(o_custkey % 3 AS INT) AS tile", "o_orderpriority AS fill", "o_custkey % 2 = 0 AS transport", "CAST((o_custkey * 7) % 900 AS INT) AS x1", "CAST((o_orderkey * 13) % 1300 AS INT) AS y1", "CAST((o_custkey * 7) % 900 + 40 AS INT) AS x2", "CAST((o_orderkey * 13) % 1300 + 30 AS INT) AS y2"]
_ENTRY_SQL = "SELECT o_orderkey AS entry_id, o_orderkey // 64 AS page, o_orderkey % 6 AS points, o_orderstatus AS method, o_custkey % 3 AS tile, o_orderpriority AS fill, o_custkey % 2 = 0 AS transport, (o_custkey * 7) % 900 AS x1, (o_orderkey * 13) % 1300 AS y1, (o_custkey * 7) % 900 + 40 AS x2, (o_orderkey * 13) % 1300 + 30 AS y2 FROM orders"


@query(
    "a10_detection_plan",
    f"SELECT page, method, tile, greatest(0, min(x1) - 64) AS x1, greatest(0, min(y1) - 64) AS y1, least(950, max(x2) + 64) AS x2, least(1350, max(y2) + 64) AS y2, count(*) AS entries FROM ({_ENTRY_SQL}) WHERE points >= 3 GROUP BY page, method, tile",
)
def a10(spark, d):
    return A.detection_plan(read(spark, d, "orders").selectExpr(*_ENTRY), "page", ["method", "tile"], 950, 1350)


@query("a10_repaint_groups", f"SELECT page, fill, transport, string_agg(entry_id::VARCHAR, ',' ORDER BY entry_id) AS entries FROM ({_ENTRY_SQL}) WHERE points >= 3 GROUP BY page, fill, transport")
def a10_groups(spark, d):
    g = A.repaint_groups(read(spark, d, "orders").selectExpr(*_ENTRY), "page")
    return g.withColumn("entries", F.array_join(F.transform("entries", lambda x: x.cast("string")), ","))


_PROB = ["l_suppkey AS page", "CAST(l_linenumber % 3 AS INT) AS scale", "CAST(l_partkey % 64 AS INT) AS y", "CAST(l_orderkey % 64 AS INT) AS x", "(l_partkey % 256) / 255.0D AS p"]
_PROB_SQL = "SELECT l_suppkey AS page, l_linenumber % 3 AS scale, l_partkey % 64 AS y, l_orderkey % 64 AS x, (l_partkey % 256) / 255.0::DOUBLE AS p FROM lineitem"


@query(
    "a11_merge_scales",
    f"SELECT page, y, x, max(p) AS coverage, CASE WHEN count(*) > 1 THEN count(*) FILTER (p > 0.5) >= least(2, count(*)) END AS agreed, count(*) AS scales FROM (SELECT page, y, x, scale, max(p) AS p FROM ({_PROB_SQL}) GROUP BY ALL) GROUP BY page, y, x",
)
def a11(spark, d):
    return A.merge_scales(read(spark, d, "lineitem").selectExpr(*_PROB), ["page", "y", "x"])


@query(
    "a12_blend_tiles",
    f"""WITH t AS (SELECT page, y, x, p, y % 32 AS ty, x % 32 AS tx FROM ({_PROB_SQL})), w AS (SELECT *, greatest((0.5 - 0.5 * cos(2 * 3.141592653589793 * ty / 31)) * (0.5 - 0.5 * cos(2 * 3.141592653589793 * tx / 31)), 1e-3) AS w FROM t)
    SELECT page, y, x, round(sum(p * w) / greatest(sum(w), 1e-6), 6) AS p, count(*) AS tiles FROM w GROUP BY page, y, x""",
)
def a12(spark, d):
    rows = read(spark, d, "lineitem").selectExpr(*_PROB).selectExpr("page", "y", "x", "p", "y % 32 AS ty", "x % 32 AS tx")
    return A.blend_tiles(rows, "page", 32).withColumn("p", F.round("p", 6))


_TOKEN = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


@query(
    "a15_collapse_tokens",
    f"""WITH t AS (SELECT user_id, event_id, {_TOKEN} AS token, round(value) AS p FROM events), k AS (SELECT *, token IS DISTINCT FROM lag(token) OVER (PARTITION BY user_id ORDER BY event_id) AND token <> 0 AS keep FROM t)
    SELECT user_id, coalesce(string_agg(token::VARCHAR, ',' ORDER BY event_id) FILTER (keep), '') AS tokens, round(avg(p) FILTER (keep), 6) AS score FROM k GROUP BY user_id""",
)
def a15(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.expr(_TOKEN).alias("token"), F.round("value").alias("p"))
    c = A.collapse_tokens(e, "user_id", "event_id")
    return c.select("user_id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"), F.round("score", 6).alias("score"))


@query("a15_argmax_steps", f"SELECT user_id, event_type, token, p FROM (SELECT user_id, event_type, event_id % 5 AS token, max(value) AS p FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY p DESC, token) = 1")
def a15_argmax(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 5).alias("token"), F.col("value").alias("p"))
    return A.argmax_steps(e, ["user_id", "event_type"])


@query(
    "a16_rollup_parts",
    "SELECT l_orderkey, count(*) AS parts, sum(l_quantity) AS size, CASE WHEN min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*) THEN 'parts' WHEN min(l_quantity) <= 0 THEN 'size' END AS problem FROM lineitem GROUP BY l_orderkey",
)
def a16(spark, d):
    return A.rollup_parts(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


# Archives of parts: some with a part that is missing, some of a wrong sum, some whole, some both, some never split.
_ASSETS_SQL = """SELECT o_orderkey AS name, i AS part, 10 + o_custkey % 9 * i AS size FROM orders, range(1, 6) r(i) WHERE o_orderkey % 11 > 1 AND i <= 2 + o_custkey % 4 AND NOT (o_orderkey % 13 = 5 AND i = 2)
    UNION ALL SELECT o_orderkey, NULL, o_custkey % 50 FROM orders WHERE o_orderkey % 11 = 1 OR o_orderkey % 17 = 3"""


@query(
    "a16_checked_archives",
    f"""WITH a AS ({_ASSETS_SQL}), b AS (SELECT o_orderkey AS name, (2 + o_custkey % 4) * 10 + o_custkey % 9 * ((2 + o_custkey % 4) * (3 + o_custkey % 4) // 2) + (CASE WHEN o_orderkey % 19 = 2 THEN 1 ELSE 0 END) AS size FROM orders WHERE o_orderkey % 11 <> 1 AND o_orderkey % 23 <> 4),
    g AS (SELECT name, count(*) AS parts, count(part) AS split, list_sort(list(part) FILTER (part IS NOT NULL)) = range(1, count(part) + 1) AS whole, sum(size) AS size, min(size) AS least FROM a GROUP BY name)
    SELECT coalesce(g.name, b.name) AS name, coalesce(parts, 0) AS parts, g.size, CASE WHEN g.name IS NULL THEN 'unsplit' WHEN split > 0 AND split < parts OR split = 0 AND parts > 1 THEN 'both' WHEN split = 0 AND b.name IS NOT NULL THEN 'unsplit'
      WHEN split > 0 AND NOT whole THEN 'parts' WHEN least <= 0 THEN 'size' WHEN split > 0 AND b.name IS NULL THEN 'unknown' WHEN split > 0 AND g.size <> b.size THEN 'sum' END AS problem
    FROM g FULL JOIN b ON g.name = b.name""",
)
def a16_checked(spark, d):
    o = read(spark, d, "orders")
    parts = o.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(5)))).where("o_orderkey % 11 > 1 AND part <= 2 + o_custkey % 4 AND NOT (o_orderkey % 13 = 5 AND part = 2)")
    parts = parts.selectExpr("o_orderkey AS name", "part", "10 + o_custkey % 9 * part AS size")
    whole = o.where("o_orderkey % 11 = 1 OR o_orderkey % 17 = 3").selectExpr("o_orderkey AS name", "CAST(NULL AS INT) AS part", "o_custkey % 50 AS size")
    built = o.where("o_orderkey % 11 <> 1 AND o_orderkey % 23 <> 4").selectExpr("o_orderkey AS name", "(2 + o_custkey % 4) * 10 + o_custkey % 9 * ((2 + o_custkey % 4) * (3 + o_custkey % 4) div 2) + IF(o_orderkey % 19 = 2, 1, 0) AS size")
    return A.rollup_parts(parts.unionByName(whole), "name", "part", "size", built)


@query("a16_nest_assets", "SELECT p_type, string_agg(s, ';' ORDER BY s) AS assets FROM (SELECT p_type, p_brand || ':' || string_agg(p_size || '=' || k, ',' ORDER BY p_size) AS s FROM (SELECT p_type, p_brand, p_size, min(p_partkey) AS k FROM part GROUP BY ALL) GROUP BY p_type, p_brand) GROUP BY p_type")
def a16_nest(spark, d):
    p = read(spark, d, "part").groupBy("p_type", "p_brand", "p_size").agg(F.min("p_partkey").alias("k"))
    n = A.nest_assets(p, "p_type", "p_brand", "p_size", "k")
    inner = lambda e: F.array_join(F.transform(F.map_entries(e["value"]), lambda v: F.concat_ws("=", v["key"].cast("string"), v["value"].cast("string"))), ",")
    texts = F.transform(F.map_entries("assets"), lambda e: F.concat(e["key"], F.lit(":"), inner(e)))
    return n.select("p_type", F.array_join(F.array_sort(texts), ";").alias("assets"))


@query(
    "a17_transfer_summary",
    """WITH l AS (SELECT user_id, event_id % 7 AS file, arg_max(event_type, event_id) AS k, arg_max(round(value), event_id) AS amount FROM events GROUP BY ALL)
    SELECT user_id, count(*) FILTER (k = 'purchase') AS done, count(*) AS files, sum(amount) AS bytes, CASE WHEN count(*) FILTER (k = 'purchase') = count(*) THEN 'finalizing' WHEN count(*) FILTER (k <> 'signup') > 0 THEN 'downloading' ELSE 'preparing' END AS phase FROM l GROUP BY user_id""",
)
def a17(spark, d):
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'start' ELSE 'advance' END")
    e = read(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("file"), "event_id", kind.alias("kind"), F.round("value").alias("amount"))
    return A.transfer_summary(e, "user_id", "file", "event_id")


_SCORED = ["o_orderkey div 64 AS page", "CAST((o_custkey * 7) % 900 AS INT) AS x1", "CAST((o_orderkey * 13) % 1300 AS INT) AS y1", "CAST((o_custkey * 7) % 900 + 20 + o_custkey % 90 AS INT) AS x2", "CAST((o_orderkey * 13) % 1300 + 20 + o_orderkey % 120 AS INT) AS y2", "(o_orderkey * 31 % 1000) / 1000.0D AS score"]
_SCORED_SQL = "SELECT o_orderkey // 64 AS page, (o_custkey * 7) % 900 AS x1, (o_orderkey * 13) % 1300 AS y1, (o_custkey * 7) % 900 + 20 + o_custkey % 90 AS x2, (o_orderkey * 13) % 1300 + 20 + o_orderkey % 120 AS y2, (o_orderkey * 31 % 1000) / 1000.0::DOUBLE AS score FROM orders"


@query(
    "a18_paint",
    f"SELECT page, cy, cx, max(score) AS score FROM (SELECT page, score, cx, unnest(range(y1 // 32, (y2 - 1) // 32 + 1)) AS cy FROM (SELECT *, unnest(range(x1 // 32, (x2 - 1) // 32 + 1)) AS cx FROM ({_SCORED_SQL}))) GROUP BY page, cy, cx HAVING max(score) > 0.35",
)
def a18(spark, d):
    return A.paint(read(spark, d, "orders").selectExpr(*_SCORED), "page", 32)


# Diamonds about a centre of each part's own, on pages of 20 parts.
_DIAMOND = ["p_partkey div 20 AS page", "30 + p_partkey * 37 % 150 AS cx", "25 + p_partkey * 53 % 90 AS cy", "5 + p_size % 40 AS a", "4 + p_partkey % 23 AS b", "(p_partkey % 10) / 10.0D AS score"]


@query(
    "a18_paint_rotated",
    """WITH d AS (SELECT p_partkey // 20 AS page, 30 + p_partkey * 37 % 150 AS cx, 25 + p_partkey * 53 % 90 AS cy, 5 + p_size % 40 AS a, 4 + p_partkey % 23 AS b, (p_partkey % 10) / 10.0 AS score FROM part),
    p AS (SELECT *, round_even(least(greatest(round(0.03 * 2 * a * b / sqrt(a * a + b * b), 9), 2), 12), 0) AS pad FROM d WHERE score > 0.35),
    c AS (SELECT page, x, y, score, a, b, pad, abs(x - cx) AS u, abs(y - cy) AS v FROM p, range(200) xs(x), range(140) ys(y) WHERE abs(x - cx) <= a + 12 AND abs(y - cy) <= b + 12),
    t AS (SELECT *, greatest(0, least(1, ((u - a) * -a + v * b) / (a * a + b * b))) AS t FROM c),
    k AS (SELECT page, y, x, max(score) AS score FROM t WHERE b * u + a * v <= a * b OR sqrt(pow(u - a * (1 - t), 2) + pow(v - b * t, 2)) <= pad + 1e-9 GROUP BY page, y, x)
    SELECT page, y, count(*) AS cells, sum(x) AS xs, round(sum(score), 6) AS scores FROM k GROUP BY page, y""",
)
def a18_rotated(spark, d):
    p = read(spark, d, "part").selectExpr(*_DIAMOND, "200 AS width", "140 AS height")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    cx, cy, a, b = (F.col(c) for c in ("cx", "cy", "a", "b"))
    p = p.withColumn("corners", F.array(point(cx, cy - b), point(cx + a, cy), point(cx, cy + b), point(cx - a, cy)))
    n = F.col("x2") - F.col("x1") + 1
    r = A.paint_rotated(p, "page", "corners")
    return r.groupBy("page", "y").agg(F.sum(n).alias("cells"), F.sum(F.expr("(x1 + x2) * (x2 - x1 + 1) div 2")).alias("xs"), F.round(F.sum(n * F.col("score")), 6).alias("scores"))


_DIMS = ["p_partkey", "CAST(600 + p_size * 10 AS INT) AS width", "CAST(400 + (p_partkey % 7) * 150 AS INT) AS height"]
_DIMS_SQL = "SELECT p_partkey, (600 + p_size * 10)::INT AS width, (400 + (p_partkey % 7) * 150)::INT AS height FROM part"


@query(
    "n3_tile_grid",
    f"SELECT p_partkey, greatest(0, least(sy * 416, height - 512))::INT AS y, greatest(0, least(sx * 416, width - 512))::INT AS x, least(512, height) AS h, least(512, width) AS w FROM (SELECT *, unnest(range(0, (greatest(height - 96, 1) - 1) // 416 + 1)) AS sy FROM (SELECT *, unnest(range(0, (greatest(width - 96, 1) - 1) // 416 + 1)) AS sx FROM ({_DIMS_SQL})))",
)
def n3(spark, d):
    return A.tile_grid(read(spark, d, "part").selectExpr(*_DIMS), "p_partkey", 512, 96)


@query("n4_pass_plan", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 24 WHEN 1 THEN 6 WHEN 3 THEN 1 ELSE 3 END AS passes FROM part")
def n4(spark, d):
    jobs = read(spark, d, "part").select("p_partkey", F.expr("CASE p_size % 5 WHEN 0 THEN 'best' WHEN 1 THEN 'fast' WHEN 2 THEN 'fastest' WHEN 3 THEN 'single' ELSE 'unheard' END").alias("preset"))
    return A.pass_plan(jobs).groupBy("p_partkey").agg(F.count("*").alias("passes"))
