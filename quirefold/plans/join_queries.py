"""Queries of the joins, fixpoints and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import crops
from quirefold.operators import joins as J
from quirefold.operators import masks
from quirefold.operators import sets as S
from quirefold.plans.registry import dealt, query, read
from quirefold.plans.session import materialise

_BOX = ["o_orderkey AS box_id", "o_orderkey div 64 AS page", "CAST((o_custkey * 7) % 900 AS DOUBLE) AS x1", "CAST((o_orderkey * 13) % 1300 AS DOUBLE) AS y1", "CAST((o_custkey * 7) % 900 + 60 + o_custkey % 90 AS DOUBLE) AS x2", "CAST((o_orderkey * 13) % 1300 + 60 + o_orderkey % 120 AS DOUBLE) AS y2", "(o_orderkey * 31 % 1000) / 1000.0D AS score"]
_BOX_SQL = "SELECT o_orderkey AS box_id, o_orderkey // 64 AS page, ((o_custkey * 7) % 900)::DOUBLE AS x1, ((o_orderkey * 13) % 1300)::DOUBLE AS y1, ((o_custkey * 7) % 900 + 60 + o_custkey % 90)::DOUBLE AS x2, ((o_orderkey * 13) % 1300 + 60 + o_orderkey % 120)::DOUBLE AS y2, (o_orderkey * 31 % 1000) / 1000.0::DOUBLE AS score FROM orders"
_IOU_SQL = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) / ((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"


def boxes(spark, d):
    return read(spark, d, "orders").selectExpr(*_BOX)


@query(
    "j1_with_speaker",
    "WITH r AS (SELECT n_name, n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN n_name END AS speaker, CASE WHEN c_nationkey % 5 <> 0 THEN 'Character ' || n END AS ordinal, CASE WHEN c_nationkey % 5 <> 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'en ' || n_name WHEN n_nationkey % 3 = 0 THEN 'ja ' || n_name ELSE substr(n_name, 1, 8) END END AS label FROM customer JOIN r ON c_nationkey = n_nationkey",
)
def j1(spark, d):
    r = read(spark, d, "nation").selectExpr(
        "n_name AS meta_id", "n_nationkey AS ord", "CASE WHEN n_nationkey % 2 = 0 THEN 'en ' || n_name ELSE ' ' END AS name_en",
        "CASE WHEN n_nationkey % 3 = 0 THEN 'ja ' || n_name END AS name_ja", "CAST(NULL AS STRING) AS alias_en", "'' AS alias_ja",
    )
    c = read(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_nationkey % 5 <> 0 THEN concat('NATION_', c_nationkey) ELSE 'unknown' END AS character_id")
    return J.with_speaker(c, r).select("c_custkey", "speaker", "ordinal", "label")


@query("j2_mentions", "SELECT DISTINCT doc_id, item_id FROM documents JOIN (SELECT item_id, substr(text, 1, 24) AS a, substr(text, 31, 20) AS b FROM benchmark) ON contains(text, a) OR contains(text, b)")
def j2(spark, d):
    b = read(spark, d, "benchmark").selectExpr("item_id", "substr(text, 1, 24) AS a", "substr(text, 31, 20) AS b")
    return J.mentions(read(spark, d, "documents").select("doc_id", "text"), b, "text", "item_id", ["a", "b"]).select("doc_id", "item_id")


@query(
    "j3_glossary",
    "WITH p AS (SELECT p_partkey, 0 AS k, p_name AS o, p_type AS e FROM part UNION ALL SELECT p_partkey, 1, p_brand, CASE WHEN p_size > 25 THEN 'b' || p_size END FROM part) SELECT o AS original, e AS english, p_partkey FROM p WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o ORDER BY p_partkey, k) = 1",
)
def j3(spark, d):
    r = read(spark, d, "part").selectExpr("p_partkey", "p_name AS name_ja", "p_type AS name_en", "p_brand AS alias_ja", "CASE WHEN p_size > 25 THEN concat('b', p_size) END AS alias_en")
    return J.glossary(r, "p_partkey").select("original", "english", "p_partkey")


@query(
    "j4_upsert_regions",
    """WITH e AS (SELECT o_orderkey // 64 AS page, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT o_orderkey // 64 AS page, o_orderkey AS k, o_orderkey % 7 AS n FROM orders WHERE o_orderkey % 2 = 0),
    b AS (SELECT coalesce(e.page, i.page) AS page, coalesce(e.k, i.k) AS k, CASE WHEN i.k IS NULL THEN 'old' ELSE 'new' END AS text, CASE WHEN e.k IS NOT NULL THEN 'styled' END AS style, CASE WHEN i.k IS NULL THEN 'kept' WHEN e.k IS NULL THEN 'added' ELSE 'replaced' END AS status FROM e FULL JOIN (SELECT * FROM i WHERE n >= 3) i ON e.page = i.page AND e.k = i.k),
    n AS (SELECT *, row_number() OVER (PARTITION BY page, status = 'added' ORDER BY CASE WHEN status = 'added' THEN k % 3 ELSE 0 END, CASE WHEN status = 'added' THEN k ELSE -k END) - 1 AS own, count(*) FILTER (status <> 'added') OVER (PARTITION BY page) AS olds, count(*) FILTER (status = 'added') OVER (PARTITION BY page) AS news FROM b),
    p AS (SELECT *, CASE WHEN page % 4 = 0 THEN least(page % 9, olds) ELSE olds END AS place FROM n)
    SELECT page, k, text, style, status, CASE WHEN status = 'added' THEN place + own WHEN own < place THEN own ELSE own + news END AS pos FROM p""",
)
def j4(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey div 64 AS page", "o_orderkey AS k", "o_orderkey % 7 AS n", "o_orderkey % 3 * 40 AS y")
    points = F.expr("array(struct(k AS x, y AS y), struct(k + 9 AS x, y AS y), struct(k AS x, y + 7 AS y))")
    e = o.where("k % 3 <> 0").select("page", points.alias("points"), F.lit("old").alias("text"), F.lit("styled").alias("style"), (-F.col("k")).alias("pos"))
    i = o.where("k % 2 = 0").select("page", F.when(F.col("n") >= 3, points).otherwise(F.slice(points, 1, 2)).alias("points"), F.lit("new").alias("text"), F.col("k").alias("pos"))
    at = o.select("page").distinct().where("page % 4 = 0").selectExpr("page", "page % 9 AS at")
    return J.upsert_regions(e, i, "page", at=at).select("page", F.col("points")[0]["x"].alias("k"), "text", "style", "status", "pos")


# regions that drift by a pixel or two from each other
_NEAR = ["l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS box_id", "l_orderkey AS page", "CAST(100 + l_linenumber % 3 AS DOUBLE) AS x1", "CAST(50 + l_partkey % 4 AS DOUBLE) AS y1", "CAST(300 + l_suppkey % 5 AS DOUBLE) AS x2", "CAST(240 + l_linenumber % 2 AS DOUBLE) AS y2"]
_NEAR_SQL = "SELECT l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS box_id, l_orderkey AS page, (100 + l_linenumber % 3)::DOUBLE AS x1, (50 + l_partkey % 4)::DOUBLE AS y1, (300 + l_suppkey % 5)::DOUBLE AS x2, (240 + l_linenumber % 2)::DOUBLE AS y2 FROM lineitem"
_TOL = "greatest(2.0, 0.02 * greatest(a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1))"


@query(
    "j5_near_duplicates",
    f"""WITH n AS ({_NEAR_SQL}) SELECT a.page, a.box_id AS a, b.box_id AS b FROM n a JOIN n b ON a.page = b.page AND a.box_id < b.box_id WHERE least((a.x2-a.x1)*(a.y2-a.y1), (b.x2-b.x1)*(b.y2-b.y1)) >= 0.97 * greatest((a.x2-a.x1)*(a.y2-a.y1), (b.x2-b.x1)*(b.y2-b.y1))
    AND abs(a.x1-b.x1) <= {_TOL} AND abs(a.y1-b.y1) <= {_TOL} AND abs((a.x2-a.x1)-(b.x2-b.x1)) <= {_TOL} AND abs((a.y2-a.y1)-(b.y2-b.y1)) <= {_TOL}""",
)
def j5(spark, d):
    p = J.near_duplicates(read(spark, d, "lineitem").selectExpr(*_NEAR), "page", "box_id")
    return p.select("page", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


# The drifting regions as pieces of their order's region, which itself is one of several sizes; some orders have one of them already.
_SPLIT = "abs(a.x1 - b.x1) <= {t} AND abs(a.y1 - b.y1) <= {t} AND abs((a.x2 - a.x1) - (b.x2 - b.x1)) <= {t} AND abs((a.y2 - a.y1) - (b.y2 - b.y1)) <= {t} AND least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) >= 0.97 * greatest((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))"
_PIECES_SQL = "SELECT l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS box_id, l_orderkey AS source, 100.0::DOUBLE + l_linenumber % 3 AS x1, 50.0::DOUBLE + l_partkey % 4 * 3 AS y1, 300.0::DOUBLE + l_suppkey % 5 * 4 AS x2, 240.0::DOUBLE + l_linenumber % 2 AS y2 FROM lineitem"


@query(
    "g5_accept_regions",
    f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY box_id) AS rank FROM ({_PIECES_SQL})),
    s AS (SELECT o_orderkey AS source, 100.0::DOUBLE AS x1, 50.0::DOUBLE AS y1, 300.0::DOUBLE + o_orderkey % 40 AS x2, 240.0::DOUBLE AS y2 FROM orders),
    k AS (SELECT a.*, row_number() OVER (PARTITION BY a.source ORDER BY a.rank) AS i FROM p a LEFT JOIN s b USING (source) WHERE NOT coalesce({_SPLIT.format(t=_TOL)}, false) AND NOT (a.source % 3 = 0 AND a.x1 = 101 AND a.y1 = 53 AND a.x2 = 304 AND a.y2 = 241)),
    f AS (SELECT source, i, box_id, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS good FROM k WHERE i = 1
      UNION ALL SELECT source, i, box_id, CASE WHEN near THEN kept ELSE list_append(kept, a) END, NOT near FROM (SELECT k.source, k.i, k.box_id, kept, {{'x1': k.x1, 'y1': k.y1, 'x2': k.x2, 'y2': k.y2}} AS a, len(list_filter(list_transform(kept, lambda b: {{'a': {{'x1': k.x1, 'y1': k.y1, 'x2': k.x2, 'y2': k.y2}}, 'b': b}}), lambda c: {_SPLIT.format(t=_TOL).replace('a.', 'c.a.').replace('b.', 'c.b.')})) > 0 AS near FROM f JOIN k ON k.source = f.source AND k.i = f.i + 1))
    SELECT source, box_id FROM f WHERE good""",
)
def g5_regions(spark, d):
    rank = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate)"
    rows = read(spark, d, "lineitem").selectExpr(f"l_orderkey * 1000000 + {rank} AS box_id", "l_orderkey AS source", f"{rank} AS rank", "100.0D + l_linenumber % 3 AS x1", "50.0D + l_partkey % 4 * 3 AS y1", "300.0D + l_suppkey % 5 * 4 AS x2", "240.0D + l_linenumber % 2 AS y2")
    corners = F.expr("array(struct(x1 AS x, y1 AS y), struct(x2 AS x, y1 AS y), struct(x2 AS x, y2 AS y), struct(x1 AS x, y2 AS y))")
    rows = rows.withColumn("points", corners)
    sources = read(spark, d, "orders").selectExpr("o_orderkey AS source", "o_orderkey AS page", "100.0D AS x1", "50.0D AS y1", "300.0D + o_orderkey % 40 AS x2", "240.0D AS y2").withColumn("points", corners)
    there = sources.where("source % 3 = 0").selectExpr("page", "-source AS source", "101.0D AS x1", "53.0D AS y1", "304.0D AS x2", "241.0D AS y2").withColumn("points", corners)
    return J.accept_regions(rows, sources, there, "source", "box_id", "page").select("source", "box_id")


@query(
    "j6_suppress",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, box_id) AS r FROM ({_BOX_SQL}) WHERE score > 0.25),
    e AS (SELECT a.page, a.r AS hi, b.r AS lo FROM s a JOIN s b ON a.page = b.page AND a.r < b.r WHERE {_IOU_SQL} > 0.3),
    k AS (SELECT page, 1::BIGINT AS r, [1::BIGINT] AS kept FROM s WHERE r = 1
      UNION ALL SELECT s.page, s.r, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.page = s.page AND e.lo = s.r AND list_contains(k.kept, e.hi)) THEN k.kept ELSE list_append(k.kept, s.r) END FROM k JOIN s ON s.page = k.page AND s.r = k.r + 1),
    f AS (SELECT page, arg_max(kept, r) AS kept FROM k GROUP BY page) SELECT s.page, box_id, row_number() OVER (PARTITION BY s.page ORDER BY s.r) AS rank FROM s JOIN f ON s.page = f.page WHERE list_contains(kept, s.r) QUALIFY rank <= 300""",
)
def j6(spark, d):
    return J.suppress(boxes(spark, d), "page", "box_id", iou=0.3).select("page", "box_id", "rank")


@query("j7_overlaps", f"WITH n AS ({_BOX_SQL}) SELECT a.page, a.box_id AS a, b.box_id AS b FROM n a JOIN n b ON a.page = b.page AND a.box_id < b.box_id AND a.x1 - 4 < b.x2 + 4 AND b.x1 - 4 < a.x2 + 4 AND a.y1 - 4 < b.y2 + 4 AND b.y1 - 4 < a.y2 + 4")
def j7(spark, d):
    return J.overlaps(boxes(spark, d), "page", "box_id", margin=4).select("page", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query(
    "j8_assign_faces",
    "WITH c AS (SELECT doc_id, unicode(substr(text, i, 1)) AS cp FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)) SELECT cp, CASE WHEN cp IN (9,10,11,12,13,32,12288) THEN NULL WHEN cp = 233 THEN 'extended' WHEN cp BETWEEN 33 AND 126 THEN 'primary' WHEN cp BETWEEN 160 AND 255 THEN 'latin' WHEN cp BETWEEN 192 AND 591 THEN 'extended' ELSE 'primary' END AS face, count(*) AS n FROM c GROUP BY ALL",
)
def j8(spark, d):
    from quirefold.plans.window_queries import characters

    cover = spark.range(33, 592).selectExpr("CAST(id AS INT) AS cp").selectExpr("cp", "explode(filter(array(if(cp < 127, 'primary', ''), if(cp BETWEEN 160 AND 255, 'latin', ''), if(cp >= 192, 'extended', '')), f -> f <> '')) AS face")
    counts = characters(read(spark, d, "documents")).groupBy("cp").agg(F.count("*").alias("n"))
    faces = J.assign_faces(materialise(counts, "j8-counts"), cover, {"primary": 0, "latin": 1, "extended": 2}, {233: "extended"})
    return faces.groupBy("cp", "face").agg(F.sum("n").alias("n"))


@query("j9_calibrate", "SELECT a.p_partkey AS cp, least(greatest(a.p_size / b.s, 0.5), 3) AS scale FROM part a JOIN (SELECT l_partkey, max(l_quantity) AS s FROM lineitem GROUP BY 1) b ON a.p_partkey = b.l_partkey")
def j9(spark, d):
    a = read(spark, d, "part").selectExpr("'a' AS face", "p_partkey AS cp", "CAST(p_size AS DOUBLE) AS height")
    b = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cp")).agg(F.max("l_quantity").alias("height")).selectExpr("'b' AS face", "cp", "height")
    return J.calibrate(a.unionByName(b), "a", "b")


@query(
    "j10_reconcile_inventory",
    "SELECT coalesce(o_orderkey, l_orderkey) AS name, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unexpected' ELSE 'size' END AS status FROM (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE n IS NULL OR o_orderkey IS NULL OR n <> 1 + o_custkey % 7",
)
def j10(spark, d):
    e = read(spark, d, "orders").where("o_orderkey % 11 <> 0").selectExpr("o_orderkey AS name", "1 + o_custkey % 7 AS size")
    a = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.count("*").alias("size"))
    return J.reconcile_inventory(e, a, "name", "size")


@query("j11_match_suffixes", "SELECT p_partkey, pattern FROM part JOIN (SELECT unnest(['ring', 'bolt', 'et', 'zzz']) AS pattern) ON ends_with(p_name, pattern)")
def j11(spark, d):
    return J.match_suffixes(read(spark, d, "part"), ["ring", "bolt", "et", "zzz"], "p_name")[0].select("p_partkey", "pattern")


@query("j11_unmet_patterns", "SELECT pattern FROM (SELECT unnest(['ring', 'bolt', 'et', 'zzz']) AS pattern) WHERE NOT EXISTS (SELECT 1 FROM part WHERE ends_with(p_name, pattern))")
def j11_unmet(spark, d):
    return J.match_suffixes(read(spark, d, "part"), ["ring", "bolt", "et", "zzz"], "p_name")[1]


@query("j12_stale", "SELECT item_id FROM benchmark WHERE item_id % 3 <> 0")
def j12(spark, d):
    b = read(spark, d, "benchmark")
    full = b.withColumn("digest", F.sha2(F.to_json(F.struct("item_id", "text")), 256)).where("item_id % 3 <> 1")
    ledger = full.withColumn("digest", F.when(F.col("item_id") % 3 == 2, F.lit("old")).otherwise(F.col("digest")))
    return J.stale(b, ledger, "item_id", ["text", "item_id"]).select("item_id")


@query(
    "j13_repair_assignments",
    """WITH a AS (SELECT p_brand AS lang, p_size AS id, min(p_partkey) AS pos FROM part GROUP BY ALL), g AS (SELECT DISTINCT p_brand AS lang, p_size AS id FROM part WHERE p_type = 'PROMO' OR p_type = 'ECONOMY'),
    k AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY pos) AS n FROM a SEMI JOIN g USING (lang, id)) SELECT lang, coalesce(string_agg(id::VARCHAR, ',' ORDER BY n), '') AS ids FROM (SELECT DISTINCT lang FROM a) LEFT JOIN (SELECT * FROM k WHERE n <= 3) USING (lang) GROUP BY lang""",
)
def j13(spark, d):
    p = read(spark, d, "part")
    active = p.groupBy(F.col("p_brand").alias("lang")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda s: s["p_size"]).alias("ids"))
    ends = p.where("p_type IN ('PROMO', 'ECONOMY')").groupBy(F.col("p_size").alias("id")).agg(F.collect_set("p_brand").alias("langs"))
    r = J.repair_assignments(active, ends)
    return r.select("lang", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "j14_apply_edits",
    """SELECT n_name AS meta_id, row_number() OVER (ORDER BY n_nationkey) AS ord, CASE WHEN n_nationkey % 4 = 1 THEN 'new ' || n_nationkey ELSE n_name END AS name_en, CASE WHEN n_nationkey % 4 <> 1 THEN 'ja' END AS name_ja FROM nation WHERE n_nationkey % 4 <> 2""",
)
def j14(spark, d):
    n = read(spark, d, "nation")
    roster = n.selectExpr("n_name AS meta_id", "n_nationkey AS ord", "n_name AS name_en", "'ja' AS name_ja", *(f"CAST(NULL AS STRING) AS {c}" for c in ("gender", "alias_en", "alias_ja")))
    edits = n.where("n_nationkey % 4 IN (1, 2)").selectExpr(
        "n_name AS meta_id", "n_nationkey AS seq", "CASE n_nationkey % 4 WHEN 1 THEN 'update' ELSE 'delete' END AS op",
        "map('name_en', concat('new ', n_nationkey), 'name_ja', ' ') AS fields",
    )
    return J.apply_edits(roster, edits)[0].select("meta_id", "ord", "name_en", "name_ja")


@query(
    "j15_resolve_defaults",
    """WITH s AS (SELECT c_custkey AS grp, c_custkey % 9 AS choice FROM customer), c AS (SELECT DISTINCT o_custkey AS grp, o_orderkey % 9 AS id, (o_orderkey % 9 * 5) % 9 AS rank FROM orders), f AS (SELECT grp, arg_min(id, rank) AS first FROM c GROUP BY 1)
    SELECT s.grp, CASE WHEN c.id IS NOT NULL THEN choice ELSE first END AS choice, (CASE WHEN c.id IS NOT NULL THEN choice ELSE first END) IS DISTINCT FROM choice AS changed FROM s LEFT JOIN c ON s.grp = c.grp AND s.choice = c.id LEFT JOIN f ON f.grp = s.grp""",
)
def j15(spark, d):
    s = read(spark, d, "customer").selectExpr("c_custkey AS grp", "c_custkey % 9 AS choice")
    c = read(spark, d, "orders").selectExpr("o_custkey AS grp", "o_orderkey % 9 AS id", "(o_orderkey % 9 * 5) % 9 AS rank").distinct()
    return J.resolve_defaults(s, c)


@query(
    "j16_assign_owners",
    """WITH i AS (SELECT o_orderstatus AS owner, o_custkey AS item, min(o_orderkey) AS pos FROM orders GROUP BY ALL), a AS (SELECT item, owner, pos FROM i WHERE owner = 'O' ORDER BY pos, item LIMIT 25), b AS (SELECT item, owner, pos FROM i WHERE owner = 'F' AND item NOT IN (SELECT item FROM a) ORDER BY pos, item LIMIT 25),
    c AS (SELECT item, owner, pos FROM i WHERE owner = 'P' AND item NOT IN (SELECT item FROM a UNION SELECT item FROM b) ORDER BY pos, item LIMIT 25) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def j16(spark, d):
    i = read(spark, d, "orders").selectExpr("o_orderstatus AS owner", "o_custkey AS item", "o_orderkey AS pos")
    return J.assign_owners(i, ["O", "F", "P"])


@query(
    "n1_components",
    f"""WITH RECURSIVE n AS (SELECT * FROM ({_BOX_SQL})), e AS (SELECT a.page, a.box_id AS a, b.box_id AS b FROM n a JOIN n b ON a.page = b.page AND a.box_id <> b.box_id AND a.x1 - 1 < b.x2 + 1 AND b.x1 - 1 < a.x2 + 1 AND a.y1 - 1 < b.y2 + 1 AND b.y1 - 1 < a.y2 + 1),
    r AS (SELECT page, box_id, box_id AS root FROM n UNION SELECT r.page, e.b, r.root FROM r JOIN e ON e.page = r.page AND e.a = r.box_id) SELECT page, box_id, min(root) AS component FROM r GROUP BY ALL""",
)
def n1(spark, d):
    return J.components(boxes(spark, d), "page", "box_id", gap=1).select("page", "box_id", "component")


@query(
    "n1_cell_components",
    """WITH RECURSIVE c AS (SELECT DISTINCT l_suppkey AS page, l_partkey % 96 AS y, l_orderkey % 96 AS x FROM lineitem), e AS (SELECT a.page, a.y, a.x, b.y AS y2, b.x AS x2 FROM c a JOIN c b ON a.page = b.page AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    r AS (SELECT page, y, x, page * 1099511627776 + y * 1048576 + x AS root FROM c UNION SELECT e.page, e.y2, e.x2, r.root FROM r JOIN e ON e.page = r.page AND e.y = r.y AND e.x = r.x) SELECT page, y, x, min(root) AS component FROM r GROUP BY ALL""",
)
def n1_cells(spark, d):
    c = read(spark, d, "lineitem").selectExpr("l_suppkey AS page", "l_partkey % 96 AS y", "l_orderkey % 96 AS x")
    return J.cell_components(c, "page")


def parts(spark, d):
    return boxes(spark, d).selectExpr("*", "CAST(x2 - x1 AS INT) AS area", "(box_id % 5) * 9.0D AS radius", "(box_id % 10) / 12.0D AS mean_p", "(box_id % 10) / 10.5D AS max_p", "(box_id * 17) % 260 AS votes", "box_id % 4 = 0 AS thin")


_PART_SQL = f"SELECT *, (x2 - x1)::INT AS area, (box_id % 5) * 9.0 AS radius, (box_id % 10) / 12.0 AS mean_p, (box_id % 10) / 10.5 AS max_p, (box_id * 17) % 260 AS votes, box_id % 4 = 0 AS thin FROM ({_BOX_SQL})"
_DIST = "pow(greatest(0, b.x1 - a.x2, a.x1 - b.x2), 2) + pow(greatest(0, b.y1 - a.y2, a.y1 - b.y2), 2)"


@query("a13_drop_specks", f"WITH p AS ({_PART_SQL}), k AS (SELECT * FROM p WHERE area >= 120) SELECT page, box_id FROM p a WHERE area >= 120 OR (area >= 15 AND page IN (SELECT page FROM k) AND (mean_p >= 0.6 OR max_p >= 0.9 OR EXISTS (SELECT 1 FROM k b WHERE b.page = a.page AND {_DIST} <= pow(3 * a.radius, 2))))")
def a13(spark, d):
    return J.drop_specks(parts(spark, d), "page", "box_id", 120).select("page", "box_id")


@query("a14_drop_unsupported", f"WITH p AS ({_PART_SQL}), k AS (SELECT * FROM p WHERE votes >= 200 OR votes >= 0.25 * area) SELECT page, box_id FROM p a WHERE votes >= 200 OR votes >= 0.25 * area OR (thin AND area <= 400) OR ((area <= 400 OR votes >= 30) AND EXISTS (SELECT 1 FROM k b WHERE b.page = a.page AND {_DIST} <= 256))")
def a14(spark, d):
    return J.drop_unsupported(parts(spark, d), "page", "box_id").select("page", "box_id")


# A page of 220 by 170 for each supplier: holes thick around the middle and thin elsewhere, by its number.
_HOLE = "(x * 7 + y * 13 + s_suppkey) % 20 < CASE WHEN x BETWEEN 50 AND 90 + s_suppkey % 70 AND y BETWEEN 40 AND 90 + s_suppkey % 40 THEN 17 ELSE s_suppkey % 14 END"
_CLUSTER = ["n AS box_id", "40 + (s_suppkey * 17 + n * 31) % 90 AS x1", "30 + (s_suppkey * 5 + n * 11) % 70 AS y1"]
_WIDER = ["x1 + 10 + (s_suppkey + n * 7) % 60 AS x2", "y1 + 8 + (s_suppkey * 3 + n) % 50 AS y2"]


@query(
    "n2_cluster_crops",
    f"""WITH h AS (SELECT s_suppkey AS page, x, y FROM supplier, range(220) xs(x), range(170) ys(y) WHERE {_HOLE}),
    c AS (SELECT *, {', '.join(_WIDER)} FROM (SELECT s_suppkey, n, {', '.join(_CLUSTER)} FROM supplier, range(3) r(n))),
    m0 AS (SELECT *, floor(least(greatest(0.6 * greatest(x2 - x1, y2 - y1), 28), 140))::INT AS a FROM c), m AS (SELECT *, floor(a * 1.6)::INT AS b, floor(floor(a * 1.6) * 1.6)::INT AS c, floor(floor(floor(a * 1.6) * 1.6) * 1.6)::INT AS d FROM m0),
    t AS (SELECT *, greatest(0, x1 - margin) AS left_, greatest(0, y1 - margin) AS top, least(220, x2 + margin) AS right_, least(170, y2 + margin) AS bottom FROM (SELECT s_suppkey AS page, box_id, x1, y1, x2, y2, k, [a, b, c, d][k + 1] AS margin FROM m, range(4) q(k))),
    s AS (SELECT t.page, box_id, x1, y1, x2, y2, k, margin, left_, top, right_, bottom, 1 - count(h.x) / ((right_ - left_) * (bottom - top)) AS share FROM t LEFT JOIN h ON h.page = t.page AND h.x >= left_ AND h.x < right_ AND h.y >= top AND h.y < bottom GROUP BY t.page, box_id, x1, y1, x2, y2, k, margin, left_, top, right_, bottom),
    f AS (SELECT * FROM s WHERE share >= 0.45 OR margin >= 320 OR k = 3 QUALIFY row_number() OVER (PARTITION BY page, box_id ORDER BY k) = 1)
    SELECT page, box_id, margin, left_ AS left, top, right_ AS right, bottom, round(share, 9) AS share, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, box_id) AS rank FROM f""",
)
def n2(spark, d):
    s = dealt(read(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    holes = s.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(219)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(169)))).where(_HOLE)
    clusters = s.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr("s_suppkey", "n", *_CLUSTER).selectExpr("s_suppkey AS page", "box_id", "x1", "y1", *_WIDER)
    pages = s.selectExpr("s_suppkey AS page", "220 AS width", "170 AS height")
    c = crops.cluster_crops(clusters, holes.selectExpr("s_suppkey AS page", "x", "y"), pages, "page", "box_id")
    return c.select("page", "box_id", "margin", "left", "top", "right", "bottom", F.round("share", 9).alias("share"), "rank")


def cells(spark, d, where):
    return read(spark, d, "lineitem").where(where).selectExpr("l_suppkey AS page", "l_partkey % 64 AS y", "l_orderkey % 64 AS x")


_CELLS = "SELECT l_suppkey AS page, l_partkey % 64 AS y, l_orderkey % 64 AS x FROM lineitem WHERE "


# Masks of a supplier's orders on a page of 400 by 300, a few runs of cells each; clusters by an ellipse of 6.
_MASK = "l_suppkey AS page, (l_partkey * 7 + l_orderkey) % 300 AS y, (l_orderkey * 13 + l_linenumber) % 380 AS x1, (l_orderkey * 13 + l_linenumber) % 380 + l_linenumber AS x2"


@query(
    "n1_ellipse_clusters",
    f"""WITH RECURSIVE m AS (SELECT DISTINCT page, y, unnest(range(x1, x2 + 1)) AS x FROM (SELECT {_MASK} FROM lineitem WHERE l_suppkey % 4 = 0 OR l_quantity > 44)),
    k AS (SELECT x AS dx, y AS dy FROM range(-6, 7) xs(x), range(-6, 7) ys(y) WHERE abs(x) <= round_even(sqrt(36 - y * y), 0)),
    o AS (SELECT DISTINCT a.dx + b.dx + c.x AS dx, a.dy + b.dy + e.y AS dy FROM k a, k b, range(-1, 2) c(x), range(-1, 2) e(y)),
    h AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS g FROM m), u AS MATERIALIZED (SELECT page, y, min(x) AS x1, max(x) AS x2, page * 1099511627776 + y * 1048576 + min(x) AS id FROM h GROUP BY page, y, g),
    w AS (SELECT dy, max(dx) AS wide FROM o GROUP BY dy), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.page = b.page JOIN w ON b.y - a.y = w.dy AND b.x1 <= a.x2 + wide AND a.x1 <= b.x2 + wide),
    r AS (SELECT id, id AS root FROM u UNION SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.id GROUP BY e.b)
    SELECT page, y, x1, x2, c.component FROM u JOIN (SELECT id, min(root) AS component FROM r GROUP BY id) c USING (id)""",
)
def n1_ellipse(spark, d):
    m = read(spark, d, "lineitem").where("l_suppkey % 4 = 0 OR l_quantity > 44").selectExpr(*_MASK.split(", "))
    return masks.clusters(m, "page", 6)


@query("u1_union_runs", f"{_CELLS}l_quantity < 5 UNION {_CELLS}l_quantity > 45")
def u1_runs(spark, d):
    a, b = (masks.runs(cells(spark, d, w), "page") for w in ("l_quantity < 5", "l_quantity > 45"))
    return masks.cells(masks.union("page", a, b), "page")


@query("u2_shared_runs", f"{_CELLS}l_quantity < 20 INTERSECT {_CELLS}l_quantity > 25 AND l_suppkey % 3 <> 0")
def u2_runs(spark, d):
    a, b = (masks.runs(cells(spark, d, w), "page") for w in ("l_quantity < 20", "l_quantity > 25 AND l_suppkey % 3 <> 0"))
    return masks.cells(masks.intersection(a, b, "page"), "page")


@query("u1_union_cells", f"{_CELLS}l_quantity < 5 UNION {_CELLS}l_quantity > 45")
def u1(spark, d):
    return S.union_cells(cells(spark, d, "l_quantity < 5"), cells(spark, d, "l_quantity > 45"))


@query("u2_own_cells", f"SELECT * FROM ({_CELLS}l_quantity < 20) WHERE page % 10 = 0 UNION ALL SELECT * FROM ({_CELLS}l_quantity < 20) SEMI JOIN ({_CELLS}l_quantity > 25 AND l_suppkey % 3 <> 0) USING (page, y, x) WHERE page % 10 <> 0")
def u2(spark, d):
    return S.own_cells(cells(spark, d, "l_quantity < 20"), cells(spark, d, "l_quantity > 25 AND l_suppkey % 3 <> 0"), ["page", "y", "x"], F.col("page") % 10 == 0)


@query("u3_touching", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def u3(spark, d):
    li = read(spark, d, "lineitem")
    return S.touching(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), li.where("l_quantity > 45"), "l_orderkey")


@query("u4_name_difference", "SELECT k, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey * 2 FROM customer) UNION ALL SELECT k, 'right' FROM (SELECT c_custkey * 2 AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u4(spark, d):
    return S.name_difference(read(spark, d, "orders").selectExpr("o_custkey AS k"), read(spark, d, "customer").selectExpr("c_custkey * 2 AS k"), "k")
