"""Queries of the column functions: cleaning, guards, colours, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import colour, geometry, text
from quirefold.operators import clean
from quirefold.plans.registry import query, read

_STRIP = "text"
for _m in text.CONTROL_MARKERS:
    _STRIP = f"replace({_STRIP}, '{_m}', '')"


@query("c1_clean_name", f"SELECT doc_id, nullif(rtrim(substr(trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')), 1, 100)), '') AS name FROM documents")
def c1(spark, d):
    return read(spark, d, "documents").select("doc_id", text.clean_name(F.col("text")).alias("name"))


@query(
    "c2_enum_guard",
    "SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ('building','machinery') THEN lower(trim(c_mktsegment)) ELSE 'other' END AS segment FROM customer",
)
def c2(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.enum_or(F.col("c_mktsegment"), ["building", "machinery"], "other").alias("segment"))


@query(
    "c3_numeric_guard",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(greatest(round_even(l_extendedprice / 100, 0), 5), 900) AS even_px, least(greatest(floor(l_tax * 100 + l_discount * 50 + 0.5), 1.0), 9.0) AS up_px, least(greatest(round_even(coalesce(try_cast(l_linestatus AS DOUBLE), 4.0), 0), 0), 7) AS guarded FROM lineitem",
)
def c3(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        text.num_or(F.col("l_extendedprice") / 100, 5, 900, 5).alias("even_px"),
        text.num_or(F.col("l_tax") * 100 + F.col("l_discount") * 50, 1, 9, 1, "up").alias("up_px"),
        text.num_or(F.col("l_linestatus"), 0, 7, 4).alias("guarded"),
    )


_WORD = "CASE o_orderkey % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'OFF' WHEN 2 THEN '1' WHEN 3 THEN 'n' WHEN 4 THEN 'maybe' WHEN 5 THEN 'TRUE' ELSE o_orderstatus END"


@query(
    "c4_bool_words",
    f"SELECT o_orderkey, CASE WHEN lower(trim({_WORD})) IN ('true','1','y','yes','on') THEN true WHEN lower(trim({_WORD})) IN ('false','0','n','no','off') THEN false END AS flag FROM orders",
)
def c4(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.bool_or(F.expr(_WORD)).alias("flag"))


@query(
    "c5_reconcile",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS size FROM part)
    SELECT p_partkey, CASE WHEN lower(trim(kind)) IN ('economy','standard','promo') THEN lower(trim(kind)) ELSE 'standard' END AS kind,
      CASE WHEN try_cast(size AS DOUBLE) IS NULL THEN 12 ELSE least(greatest(round_even(try_cast(size AS DOUBLE), 0), 1), 40) END AS size,
      (CASE WHEN kind IS NULL THEN 'kind' ELSE '' END) AS missing,
      concat_ws(',', CASE WHEN kind IS NOT NULL AND lower(trim(kind)) NOT IN ('economy','standard','promo') THEN 'kind' END, CASE WHEN try_cast(size AS DOUBLE) IS NULL THEN 'size' END) AS invalid,
      (CASE WHEN try_cast(size AS DOUBLE) IS NOT NULL AND least(greatest(round_even(try_cast(size AS DOUBLE), 0), 1), 40) <> try_cast(size AS DOUBLE) THEN 'size' ELSE '' END) AS changed FROM s""",
)
def c5(spark, d):
    part = read(spark, d, "part").select(
        "p_partkey",
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END").alias("kind"),
        F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END").alias("size"),
    )
    spec = {"kind": clean.EnumField(["economy", "standard", "promo"], "standard"), "size": clean.NumberField(1, 40, 12)}
    rows = clean.reconcile(part, spec)
    return rows.select("p_partkey", "kind", "size", *(F.array_join(c, ",").alias(c) for c in ("missing", "invalid", "changed")))


@query(
    "c5_reconcile_report",
    """WITH s AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS size FROM part),
    f AS (SELECT 'missing' AS status, 'kind' AS field FROM s WHERE kind IS NULL UNION ALL SELECT 'invalid', 'kind' FROM s WHERE kind IS NOT NULL AND lower(trim(kind)) NOT IN ('economy','standard','promo')
      UNION ALL SELECT 'invalid', 'size' FROM s WHERE try_cast(size AS DOUBLE) IS NULL UNION ALL SELECT 'changed', 'size' FROM s WHERE least(greatest(round_even(try_cast(size AS DOUBLE), 0), 1), 40) <> try_cast(size AS DOUBLE))
    SELECT status, field, count(*) AS n FROM f GROUP BY ALL""",
)
def c5_report(spark, d):
    part = read(spark, d, "part").select(
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END").alias("kind"),
        F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END").alias("size"),
    )
    spec = {"kind": clean.EnumField(["economy", "standard", "promo"], "standard"), "size": clean.NumberField(1, 40, 12)}
    return clean.report(clean.reconcile(part, spec))


@query(
    "c6_resolve_lang",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'EN-US' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' WHEN 'es' THEN 'ES' END AS target, CASE lang WHEN 'en' THEN 'EN' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' WHEN 'es' THEN 'ES' END AS source, CASE WHEN lang IS NULL OR lang = '' THEN 'missing' WHEN lang NOT IN ('en','fr','de','es') THEN 'unsupported' END AS error FROM documents",
)
def c6(spark, d):
    docs = clean.resolve_lang(read(spark, d, "documents").select("doc_id", "lang"), "lang", "target", "target")
    docs = clean.resolve_lang(docs.withColumnRenamed("error", "e1"), "lang", "source", "source")
    return docs.select("doc_id", "target", "source", "error")


@query(
    "c7_redact",
    r"""SELECT page_id, replace(regexp_replace(regexp_replace(url, '(https?://[^\s?#]+)[?#][^\s]*', '\1?[redacted]', 'gi'), '(https?://)[^\s/@]+:[^\s/@]+@', '\1[redacted]@', 'gi'), chr(10), '\n') AS url FROM pages""",
)
def c7(spark, d):
    return read(spark, d, "pages").select("page_id", text.redact(F.col("url")).alias("url"))


@query(
    "c7_redact_text",
    r"""SELECT doc_id, md5(replace(replace(regexp_replace(regexp_replace(text, '\b(authorization|api[ _-]?key|access[ _-]?token|token|password|secret)([\s"'']*[:=][\s"'']*)(?:bearer\s+)?[^\s,;"''<>]+', '\1\2[redacted]', 'gi'), '\bbearer\s+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'gi'), chr(13), '\r'), chr(10), '\n')) AS digest FROM documents WHERE text NOT LIKE '%://%'""",
)
def c7_text(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


_REPLY = "CASE turn % 4 WHEN 0 THEN concat('```json', chr(10), text, chr(10), '```') WHEN 1 THEN concat('<think>', role, '</think> ', text) WHEN 2 THEN concat('<think>', text) ELSE concat('\"', text, '\"') END"


@query(
    "c8_clean_reply",
    "SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN NULL WHEN turn % 4 = 3 AND (text LIKE '%\"%' OR role LIKE '%\"%') THEN concat('\"', text, '\"') WHEN turn % 4 = 1 THEN ltrim(text, ' ' || chr(10)) ELSE text END AS reply FROM conversations WHERE text = trim(text, ' ' || chr(10) || chr(9) || chr(13))",
)
def c8(spark, d):
    conv = read(spark, d, "conversations")
    return conv.select("conv_id", "turn", text.clean_reply(F.expr(_REPLY), F.col("role")).alias("reply"))


@query(
    "c9_split_speaker",
    """WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN NULL WHEN turn % 3 = 1 THEN 'A ' || role ELSE role END AS tag FROM conversations WHERE text NOT LIKE '[%'),
    r AS (SELECT DISTINCT role FROM conversations) SELECT conv_id, turn, t.tag, r.role AS label, t.text AS body FROM t LEFT JOIN r ON lower(t.tag) = lower(r.role)""",
)
def c9(spark, d):
    conv = read(spark, d, "conversations")
    tagged = F.expr("CASE WHEN turn % 3 = 2 THEN text WHEN turn % 3 = 1 THEN concat('[x]: [A ', role, ']: ', text) ELSE concat('[', role, ']:', text) END")
    return clean.speaker_labels(conv.select("conv_id", "turn", tagged.alias("text")), conv.select("role").distinct(), "role")


@query("c10_normalise_ocr", "SELECT doc_id, replace(replace(text, '!', '！'), '！', '!') AS text FROM documents")
def c10(spark, d):
    return read(spark, d, "documents").select("doc_id", text.normalise_ocr(F.translate("text", "!", "！")).alias("text"))


@query(
    "c11_placeholders",
    "SELECT doc_id, replace(replace(replace('<SOURCE_LANG>><TARGET_LANG>: <TEXT>', '<TEXT>', coalesce(text, '')), '<SOURCE_LANG>', coalesce(lang, '')), '<TARGET_LANG>', coalesce(source, '')) AS prompt FROM documents",
)
def c11(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", text.apply_placeholders(F.lit("<SOURCE_LANG>><TARGET_LANG>: <TEXT>"), F.col("text"), F.col("lang"), F.col("source")).alias("prompt"))


_RGB = "l_partkey % 256 AS r, (l_partkey * 3 + l_linenumber) % 256 AS g, (CAST(l_quantity AS INT) * 5) % 256 AS b"


@query(
    "c12_contrast",
    f"WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, {_RGB} FROM lineitem) SELECT l_orderkey, l_linenumber, l_suppkey, r, g, b, CASE WHEN (299*r + 587*g + 114*b) / 1000.0 > 127 THEN '#000000' ELSE '#ffffff' END AS ink, CASE WHEN greatest(r, g, b) > 40 THEN '#' || lower(printf('%02x%02x%02x', r, g, b)) ELSE '#ffffff' END AS text_colour, CAST(least(greatest(round_even(l_suppkey * 0.09, 0), 1), 32) AS INT) AS outline FROM p",
)
def c12(spark, d):
    p = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *(F.expr(x) for x in ("l_partkey % 256 AS r", "(l_partkey * 3 + l_linenumber) % 256 AS g", "(CAST(l_quantity AS INT) * 5) % 256 AS b")))
    hexed = F.concat(F.lit("#"), *(F.lpad(F.hex(c), 2, "0") for c in ("r", "g", "b")))
    plate = colour.parse_colour(F.lit("#000"))
    none = F.lit(None).cast("struct<r:int,g:int,b:int,a:int>")
    return p.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "r", "g", "b",
        colour.contrast(F.col("r"), F.col("g"), F.col("b")).alias("ink"),
        colour.resolve_colour(none, colour.parse_colour(hexed), plate).alias("text_colour"),
        colour.auto_outline(F.col("l_suppkey")).alias("outline"),
    )


_VERSION = "concat(o_orderkey % 3, '.', o_custkey % 4, '.', o_orderkey % 5, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-rc' WHEN 2 THEN '+build' ELSE '.9' END)"


@query(
    "c13_version_order",
    "SELECT o_orderkey, (o_orderkey % 3) * 10000 + (o_custkey % 4) * 100 + (o_orderkey % 5) AS number, o_orderkey % 4 IN (0, 2) AS final, (o_orderkey % 3, o_custkey % 4, o_orderkey % 5, CAST(o_orderkey % 4 IN (0, 2) AS INT)) < (1, 2, 3, 1) AS older FROM orders",
)
def c13(spark, d):
    v = text.version_key(F.expr(_VERSION))
    o = read(spark, d, "orders").select("o_orderkey", v.alias("v"))
    return o.select(
        "o_orderkey", (F.col("v.major") * 10000 + F.col("v.minor") * 100 + F.col("v.patch")).alias("number"), F.col("v.final").alias("final"),
        (F.col("v") < text.version_key(F.lit("1.2.3"))).alias("older"),
    )


@query("c14_safe_name", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages WHERE regexp_extract(url, '([^/]*)$', 1) NOT IN ('', '.', '..')")
def c14(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("name"))
    return p.where(text.safe_name(F.col("name")))


@query(
    "c15_binarise",
    f"WITH p AS (SELECT l_suppkey AS page, {_RGB} FROM lineitem) SELECT page, count(*) AS pixels, sum(CASE WHEN (299*r + 587*g + 114*b) / 1000.0 > 160 THEN 255 ELSE 0 END) AS ink FROM p GROUP BY page",
)
def c15(spark, d):
    p = read(spark, d, "lineitem").selectExpr("l_suppkey AS page", "l_partkey % 256 AS r", "(l_partkey * 3 + l_linenumber) % 256 AS g", "(CAST(l_quantity AS INT) * 5) % 256 AS b")
    v = colour.binarise(F.col("r"), F.col("g"), F.col("b"))
    return p.groupBy("page").agg(F.count("*").alias("pixels"), F.sum(v).alias("ink"))


_BOX = ["o_orderkey AS box_id", "o_orderkey div 64 AS page", "CAST((o_custkey * 7) % 900 AS DOUBLE) AS x", "CAST((o_orderkey * 13) % 1300 AS DOUBLE) AS y", "CAST(o_custkey % 160 - 20 AS DOUBLE) AS w", "CAST(o_orderkey % 120 - 10 AS DOUBLE) AS h"]
_BOX_SQL = "SELECT o_orderkey AS box_id, o_orderkey // 64 AS page, ((o_custkey * 7) % 900)::DOUBLE AS x, ((o_orderkey * 13) % 1300)::DOUBLE AS y, (o_custkey % 160 - 20)::DOUBLE AS w, (o_orderkey % 120 - 10)::DOUBLE AS h FROM orders"


def _boxes(spark, d):
    return read(spark, d, "orders").selectExpr(*_BOX)


@query(
    "g1_region_points",
    f"SELECT box_id, least(x, x+w) AS x1, least(y, y+h) AS y1, greatest(x, x+w) AS x2, greatest(y, y+h) AS y2, abs(w) * abs(h) AS area FROM ({_BOX_SQL})",
)
def g1(spark, d):
    p = _boxes(spark, d).withColumn("p", geometry.rect_points(*(F.col(c) for c in "xywh")))
    b = geometry.bbox(F.col("p"))
    return p.select("box_id", *(b[k].alias(k) for k in ("x1", "y1", "x2", "y2")), geometry.polygon_area(F.col("p")).alias("area"))


@query("g2_usable", f"SELECT box_id FROM ({_BOX_SQL}) WHERE abs(w) >= 2 AND abs(h) >= 2 AND abs(w) * abs(h) >= 24")
def g2(spark, d):
    p = _boxes(spark, d).withColumn("p", geometry.rect_points(*(F.col(c) for c in "xywh")))
    return p.where(geometry.usable(F.col("p"))).select("box_id")


@query(
    "g3_scale_boxes",
    f"SELECT box_id, round(least(greatest((x - round_even(12.5 - 0.1, 0)) / 0.75, 0), 1000), 6) AS x, round(least(greatest((y - round_even(0.0 - 0.1, 0)) / 0.75, 0), 1400), 6) AS y FROM ({_BOX_SQL})",
)
def g3(spark, d):
    p = _boxes(spark, d)
    return p.select(
        "box_id",
        F.round(geometry.unletterbox(F.col("x"), F.lit(12.5), F.lit(0.75), F.lit(1000)), 6).alias("x"),
        F.round(geometry.unletterbox(F.col("y"), F.lit(0.0), F.lit(0.75), F.lit(1400)), 6).alias("y"),
    )


@query(
    "g4_pad_boxes",
    f"SELECT box_id, round_even(greatest(least(0.03 * least(abs(w), abs(h)), 12), 2), 0) AS clean_pad, round_even(greatest(least(0.18 * least(abs(w), abs(h)), 12), 1), 0) AS colour_pad FROM ({_BOX_SQL})",
)
def g4(spark, d):
    w, h = F.abs("w"), F.abs("h")
    return _boxes(spark, d).select("box_id", geometry.pad_amount(w, h, 0.03, 2, 12).alias("clean_pad"), geometry.pad_amount(w, h, 0.18, 1, 12).alias("colour_pad"))


@query(
    "g5_accept_pieces",
    f"""WITH b AS (SELECT page, box_id, abs(w) * abs(h) AS area FROM ({_BOX_SQL})), t AS (SELECT *, sum(area) OVER (PARTITION BY page) AS region FROM b),
    k AS (SELECT * FROM t WHERE area >= greatest(24, floor(0.004 * region)) AND area < greatest(region - greatest(24, floor(0.004 * region)), floor(0.99 * region))),
    n AS (SELECT *, count(*) OVER (PARTITION BY page) AS kept, row_number() OVER (PARTITION BY page ORDER BY area DESC, box_id) AS rank FROM k) SELECT page, box_id, area, rank FROM n WHERE kept >= 2""",
)
def g5(spark, d):
    b = _boxes(spark, d).select("page", "box_id", (F.abs("w") * F.abs("h")).alias("area"))
    return clean.accept_pieces(b, "page", "box_id", "area")


@query(
    "g6_type_area",
    f"""WITH c AS (SELECT box_id, greatest(x, 0)::INT AS x1, greatest(y, 0)::INT AS y1, least(x + 100 + w, 950)::INT AS x2, least(y + 60 + h, 1300)::INT AS y2 FROM ({_BOX_SQL})),
    p AS (SELECT *, greatest(5, floor((x2 - x1) * 0.12)::INT) AS px, greatest(4, floor((y2 - y1) * 0.10)::INT) AS py FROM c)
    SELECT box_id, x1 + px AS x, y1 + py AS y, greatest(1, x2 - x1 - 2 * px) AS w, greatest(1, y2 - y1 - 2 * py) AS h FROM p""",
)
def g6(spark, d):
    b = _boxes(spark, d)
    cast = lambda c: F.expr(f"CAST({c} AS INT)")
    a = geometry.type_area(cast("x"), cast("y"), cast("x + 100 + w"), cast("y + 60 + h"), F.lit(950), F.lit(1300))
    return b.select("box_id", a.alias("a")).select("box_id", "a.x", "a.y", "a.w", "a.h")


@query(
    "g7_filter_candidates",
    f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box_id) AS nth, (box_id * 31 % 1000) / 1000.0 AS score FROM ({_BOX_SQL}))
    SELECT page, box_id, greatest(0, least(round_even(x - 1.5, 0), 900))::INT AS x1, greatest(0, least(round_even(y - 1.5, 0), 1300))::INT AS y1 FROM b WHERE nth <= 1000 AND least(w, h) >= 3 AND score >= 0.6 AND least(w, h) + 3 >= 5""",
)
def g7(spark, d):
    b = _boxes(spark, d).withColumn("score", F.expr("(box_id * 31 % 1000) / 1000.0D"))
    return clean.filter_candidates(b, "page", "box_id", grow=1.5, width=900, height=1300).select("page", "box_id", "x1", "y1")


_CONTOUR = ["o_orderkey AS id", "o_orderkey div 64 AS page", "o_custkey * 7 % 900 AS x", "o_orderkey * 13 % 1300 AS y", "1 + o_custkey % 60 AS w", "1 + o_orderkey % 40 AS h", "(o_orderkey % 10) / 10.0D AS score"]


@query(
    "g7_contour_boxes",
    """WITH c AS (SELECT o_orderkey AS id, o_orderkey // 64 AS page, o_custkey * 7 % 900 AS x, o_orderkey * 13 % 1300 AS y, 1 + o_custkey % 60 AS w, 1 + o_orderkey % 40 AS h, (o_orderkey % 10) / 10.0 AS score FROM orders),
    g AS (SELECT *, w * h * 1.5::DOUBLE / (2 * (w + h)) AS g FROM c WHERE score >= 0.6 AND least(w, h) >= 3)
    SELECT page, id, greatest(0, least(950, round_even(round(x - g, 9), 0)::INT)) AS x1, greatest(0, least(1300, round_even(round(y - g, 9), 0)::INT)) AS y1, greatest(0, least(950, round_even(round(x + w + g, 9), 0)::INT)) AS x2, greatest(0, least(1300, round_even(round(y + h + g, 9), 0)::INT)) AS y2, round(g, 6) AS grow
    FROM g WHERE round(least(w, h) + 2 * g, 9) >= 5""",
)
def g7_contour(spark, d):
    c = read(spark, d, "orders").selectExpr(*_CONTOUR)
    at = lambda x, y: f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)"
    points = F.expr(f"array({at('x + w', 'y + h')}, {at('x', 'y')}, {at('x + w / 2', 'y')}, {at('x + w', 'y')}, {at('x + w / 3', 'y + h / 2')}, {at('x', 'y + h')})")
    b = clean.boxes_from_contours(c.withColumn("points", points), "page", "id", "points", "score", width=950, height=1300)
    corner = F.col("box")
    return b.select("page", "id", corner[0]["x"].alias("x1"), corner[0]["y"].alias("y1"), corner[2]["x"].alias("x2"), corner[2]["y"].alias("y2"), F.round("grow", 6).alias("grow"))


@query(
    "g8_place_blocks",
    f"""WITH p AS (SELECT box_id, CASE box_id % 3 WHEN 0 THEN x WHEN 1 THEN x + 120 - (60 + w) ELSE x + (120 - (60 + w)) / 2 END AS lft, 60 + w AS bw FROM ({_BOX_SQL}))
    SELECT box_id, lft, CAST(CASE WHEN bw > 900 THEN 0 WHEN lft < 0 THEN ceil(-lft) WHEN lft + bw > 900 THEN -ceil(lft + bw - 900) ELSE 0 END AS INT) AS shift FROM p""",
)
def g8(spark, d):
    b = _boxes(spark, d).withColumn("bw", F.col("w") + 60)
    align = F.expr("CASE box_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'center' END")
    b = b.withColumn("lft", geometry.place_block(F.col("x"), F.lit(120.0), F.col("bw"), align))
    return b.select("box_id", "lft", geometry.shift_inside(F.col("lft"), F.col("lft") + F.col("bw"), F.lit(900.0)).alias("shift"))
