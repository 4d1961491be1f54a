"""Queries of event state (batch twins), sources over tables, and hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.headers import image_size
from quirefold.operators import hooks
from quirefold.plans.registry import ORACLES, query, read
from quirefold.plans.session import shared_dir
from quirefold.sources import rosters
from quirefold.streaming import pacing, state

_KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'error' ELSE 'message' END"


def event_stream(spark, d):
    """The events table as a stream of its files."""
    rows = read(spark, d, "events")
    # a glob, as a single file is no folder to watch
    return spark.readStream.schema(rows.schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, df, mode):
    """All that a stream gives over what is there now, with the number of its batch.

    Each batch replaces its own folder, so that one run again after a failure counts once.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    go = df.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    go.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/out")


def newest(rows, *keys):
    """The last state of each key in a stream of updates."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("s"))
    return last.select(*(F.col(f"s.{c}") for c in rows.columns if c != "batch"))


def task_events(spark, d, rows=None):
    return (read(spark, d, "events") if rows is None else rows).selectExpr(
        "ts", "event_id AS seq", "concat('u', user_id) AS task", f"{_KIND} AS kind",
        "CAST(CASE WHEN event_type = 'click' THEN floor(value) END AS BIGINT) AS done", "CAST(NULL AS BIGINT) AS total",
        "CASE WHEN event_type IN ('view', 'purchase') THEN props END AS line",
    )


@query(
    "t1_task_state",
    f"""WITH e AS (SELECT ts, event_id AS seq, 'u' || user_id AS task, {_KIND} AS kind, CASE WHEN event_type = 'click' THEN floor(value)::BIGINT END AS done, CASE WHEN event_type IN ('view', 'purchase') THEN props END AS line FROM events),
    r AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY seq) AS run FROM e), l AS (SELECT * FROM r QUALIFY run = max(run) OVER (PARTITION BY task)),
    x AS (SELECT *, coalesce(max(CASE WHEN kind IN ('finish', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM l)
    SELECT task, min(ts) AS started, max(ts) AS updated, arg_max(done, seq) FILTER (done IS NOT NULL) AS done, NULL::BIGINT AS total, least(count(line) FILTER (kind <> 'finish'), 60) + count(line) FILTER (kind = 'finish') AS lines, arg_max(line, seq) FILTER (line IS NOT NULL) AS last_line,
    CASE arg_max(kind, seq) WHEN 'finish' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM x WHERE ended = 0 GROUP BY task""",
)
def t1(spark, d):
    return state.task_state_batch(task_events(spark, d))


def transfer_events(spark, d, rows=None):
    return (read(spark, d, "events") if rows is None else rows).selectExpr(
        "ts", "event_id AS seq", "concat('j', user_id) AS job", "concat('f', event_id % 5) AS file", "event_id div 2500 AS attempt",
        "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' ELSE 'advance' END AS kind",
        "CAST(floor(value) AS BIGINT) AS amount", "CAST(CASE WHEN event_type = 'signup' THEN 100 END AS BIGINT) AS start",
        "CAST(CASE WHEN event_type = 'signup' THEN 5000 END AS BIGINT) AS total",
    )


@query(
    "t2_transfer_state",
    """WITH e AS (SELECT event_id AS seq, 'j' || user_id AS job, 'f' || (event_id % 5) AS file, event_id // 2500 AS attempt, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' ELSE 'advance' END AS kind, floor(value)::BIGINT AS amount, CASE WHEN event_type = 'signup' THEN 100 END AS start, CASE WHEN event_type = 'signup' THEN 5000 END AS total FROM events),
    x AS (SELECT *, coalesce(max(CASE WHEN kind = 'finish' THEN 1 ELSE 0 END) OVER (PARTITION BY job, file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM e), l AS (SELECT * FROM x WHERE o = 0 QUALIFY attempt = max(attempt) OVER (PARTITION BY job, file)),
    g AS (SELECT job, file, max(amount) FILTER (kind = 'finish') AS size, coalesce(sum(amount) FILTER (kind = 'advance'), 0) AS moved, coalesce(max(start), 0) AS start, max(total) AS total FROM l GROUP BY ALL)
    SELECT job, file, coalesce(size, start + moved) AS count, coalesce(size, total) AS total, CASE WHEN size IS NOT NULL THEN 'finalizing' WHEN moved > 0 THEN 'downloading' ELSE 'preparing' END AS phase FROM g""",
)
def t2(spark, d):
    return state.transfer_state_batch(transfer_events(spark, d))


@query(
    "t3_throttle",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, event_type = 'purchase' AS forced, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, s AS last, true AS out FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN forced OR s - last >= 3600 THEN s ELSE last END, forced OR s - last >= 3600 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, event_id FROM f WHERE out""",
)
def t3(spark, d):
    e = read(spark, d, "events").withColumn("forced", F.col("event_type") == "purchase").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return pacing.throttle_batch(e, "user_id", "event_id", "s", "forced", gap=3600.0)


@query(
    "t4_admit",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, floor(value)::INT % 13 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, n <= 10 AS admitted, CASE WHEN n <= 10 THEN [{'t': t, 'n': n}] ELSE [] END AS held FROM e WHERE i = 1
      UNION ALL SELECT user_id, event_id, i, good, CASE WHEN good THEN list_append(kept, {'t': t, 'n': n}) ELSE kept END FROM (
        SELECT *, n <= 10 AND coalesce(list_sum(list_transform(kept, lambda x: x.n)), 0) + n <= 60 AS good FROM (
          SELECT e.user_id, e.event_id, e.i, e.t, e.n, list_filter(held, lambda x: e.t - x.t < 86400000000) AS kept FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
    SELECT user_id AS client, event_id AS batch, admitted FROM f""",
)
def t4(spark, d):
    e = read(spark, d, "events").selectExpr("user_id AS client", "ts", "event_id AS batch", "CAST(floor(value) % 13 AS INT) AS events")
    return state.admit_batch(e, span=86400.0)


# The same four as streams, against the same SQL. The watermark waits longer than the table is, as a table's files have no order.
_WAIT = "400 days"


@query("t1_task_stream", ORACLES["t1_task_state"])
def t1_stream(spark, d):
    live = state.task_state(task_events(spark, d, event_stream(spark, d)), delay=_WAIT)
    return newest(drained(spark, live, "update"), "task")


@query("t2_transfer_stream", ORACLES["t2_transfer_state"])
def t2_stream(spark, d):
    live = state.transfer_state(transfer_events(spark, d, event_stream(spark, d)), delay=_WAIT)
    return newest(drained(spark, live, "update"), "job", "file")


@query("t3_throttle_stream", f"SELECT user_id, ts FROM ({ORACLES['t3_throttle']}) JOIN events USING (user_id, event_id)")
def t3_stream(spark, d):
    e = event_stream(spark, d).withColumn("forced", F.col("event_type") == "purchase")
    return drained(spark, state.throttle(e, "user_id", "ts", "forced", gap=3600.0, delay=_WAIT), "append").drop("batch")


@query("t4_admit_stream", ORACLES["t4_admit"])
def t4_stream(spark, d):
    e = event_stream(spark, d).selectExpr("user_id AS client", "ts", "event_id AS batch", "CAST(floor(value) % 13 AS INT) AS events")
    live = state.admit(e, span=86400.0, delay=_WAIT)
    return drained(spark, live.withColumnRenamed("batch", "name"), "append").select("client", F.col("name").alias("batch"), "admitted")


@query(
    "t5_late_events",
    f"""WITH e AS (SELECT event_id AS seq, 'u' || user_id AS task, {_KIND} AS kind FROM events),
    r AS (SELECT *, (SELECT max(s.seq) FROM e s WHERE s.task = e.task AND s.kind = 'start' AND s.seq <= e.seq) AS began FROM e)
    SELECT task, count(*) AS late, min(seq) AS first FROM r WHERE EXISTS (SELECT 1 FROM e x WHERE x.task = r.task AND x.seq < r.seq AND x.kind IN ('finish', 'error') AND x.seq >= coalesce(r.began, -1)) GROUP BY task""",
)
def t5(spark, d):
    late = state.late_events(task_events(spark, d))
    return late.groupBy("task").agg(F.count("*").alias("late"), F.min("seq").alias("first"))


@query("f1_recognise", "SELECT doc_id, upper(source) AS text, 'primary' AS engine, NULL::VARCHAR AS error FROM documents")
def f1(spark, d):
    upper = lambda: lambda values: [v.upper() for v in values]
    return hooks.recognise(read(spark, d, "documents").select("doc_id", "source"), upper, payload="source").select("doc_id", "text", "engine", "error")


@query("f2_translate", "SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'system' THEN 500 ELSE 200 END AS code, CASE WHEN role <> 'system' THEN upper(role) END AS data FROM conversations")
def f2(spark, d):
    def factory():
        def call(text):
            if text == "system":
                raise ValueError("refused")
            return text.upper()

        return call

    r = read(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "role")
    return hooks.translate(r, factory, "id", "role").select("id", "code", "data")


@query("s1_catalogue", "SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY a, name) AS seq, width, height FROM (SELECT 'd' || (p_partkey // 100) AS folder, 'p' || p_partkey || '.PNG' AS name, p_partkey AS a, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 10 END AS width, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 100 END AS height FROM part WHERE p_partkey % 7 <> 0)")
def s1(spark, d):
    f = read(spark, d, "part").selectExpr("concat('d', p_partkey div 100, '/', CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END, 'p', p_partkey, '.PNG') AS path", "CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size * 10 END AS width", "CASE WHEN p_size % 5 = 0 THEN -1 ELSE 100 END AS height")
    return rosters.catalogue(f)


# Header bytes of a picture for each part, of seven types in ten forms and of none, from its width and height.
_BE = "lpad(hex({0}), {1}, '0')"
_LE2 = "concat(lpad(hex({0} % 256), 2, '0'), lpad(hex({0} div 256 % 256), 2, '0'))"
_LE3 = f"concat({_LE2}, lpad(hex({{0}} div 65536), 2, '0'))"
_LE4 = f"concat({_LE2}, lpad(hex({{0}} div 65536 % 256), 2, '0'), lpad(hex({{0}} div 16777216), 2, '0'))"
_FORMS = [
    f"concat('89504E470D0A1A0A0000000D49484452', {_BE.format('w', 8)}, {_BE.format('h', 8)})",
    f"concat('FFD8FFE0000400AAFFDB0003EEFFFFC2000B08', {_BE.format('h', 4)}, {_BE.format('w', 4)}, '03')",
    f"concat('524946460000000057454250565038580A00000000000000', {_LE3.format('(w - 1)')}, {_LE3.format('(h - 1)')})",
    f"concat('52494646000000005745425056503820000000001020309D012A', {_LE2.format('w')}, {_LE2.format('h')})",
    f"concat('5249464600000000574542505650384C000000002F', {_LE4.format('((h - 1) * 16384 + w - 1)')})",
    f"concat('424D00000000000000000000000028000000', {_LE4.format('w')}, {_LE4.format('(4294967296 - h)')})",
    f"concat('424D0000000000000000000000000C000000', {_LE2.format('w')}, {_LE2.format('h')})",
    f"concat('474946383961', {_LE2.format('w')}, {_LE2.format('h')})",
    f"concat('00000018667479706D69663100000000617669660000AA0000001469737065000000000000000200000003', '0000001469737065', '00000000', {_BE.format('w', 8)}, {_BE.format('h', 8)})",
    "'FFD8FFDA0000'",
]


@query("s1_image_sizes", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 1 + p_size * 37 + p_partkey % 50 END AS width, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 5 + p_size * 11 + p_partkey % 90 END AS height FROM part")
def s1_sizes(spark, d):
    p = read(spark, d, "part").selectExpr("p_partkey", "1 + p_size * 37 + p_partkey % 50 AS w", "5 + p_size * 11 + p_partkey % 90 AS h")
    forms = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_FORMS))
    made = p.select("p_partkey", F.unhex(F.expr(f"CASE p_partkey % 10 {forms} END")).alias("content"))
    return made.select("p_partkey", image_size(F.col("content")).alias("s")).select("p_partkey", "s.width", "s.height")


@query("s2_saved_pages", "SELECT page_id AS name FROM pages WHERE page_id IN (SELECT p_partkey * 3 FROM part)")
def s2(spark, d):
    return rosters.saved_pages(read(spark, d, "pages").selectExpr("page_id AS name"), read(spark, d, "part").selectExpr("p_partkey * 3 AS name"))


@query(
    "s3_roster_csv",
    """SELECT CAST(c_nationkey AS VARCHAR) AS dest, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord, c_name AS name_en, NULL::VARCHAR AS name_ja, CASE WHEN c_custkey % 2 = 0 THEN 'male' END AS gender, c_mktsegment AS alias_en, true AS id_ok
    FROM customer WHERE c_custkey % 11 <> 0 QUALIFY ord <= 50""",
)
def s3(spark, d):
    blank = F.col("c_custkey") % 11 == 0
    c = read(spark, d, "customer").select(
        F.col("c_nationkey").alias("dest"), "c_custkey", F.when(~blank, F.col("c_name")).alias(" Name_EN "), F.lit("x").alias("note"),
        F.when(~blank, F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("unknown")).alias("GENDER"), F.when(~blank, F.concat(F.lit(" "), "c_mktsegment")).alias("Alias_en"),
    )
    folder = f"{shared_dir(spark)}/s3-{uuid.uuid4().hex}"
    c.repartition("dest").sortWithinPartitions("dest", "c_custkey").drop("c_custkey").write.partitionBy("dest").csv(folder, header=True)
    r = rosters.read_roster_csv(spark, folder)
    n = F.count("*").over(Window.partitionBy("meta_id"))
    return r.select("dest", "ord", "name_en", "name_ja", "gender", "alias_en", ((F.length("meta_id") == 8) & (n == 1)).alias("id_ok"))


@query(
    "s6_save_roster",
    """WITH new AS (SELECT c_nationkey AS dest, c_custkey AS ord, c_mktsegment AS name_en FROM customer WHERE c_nationkey % 3 = 0 AND c_custkey % 2 = 0)
    SELECT * FROM new UNION ALL SELECT c_nationkey, c_custkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT dest FROM new)""",
)
def s6(spark, d):
    c = read(spark, d, "customer").selectExpr("c_nationkey AS dest", "c_custkey AS ord", "c_name AS name_en", "c_mktsegment")
    folder = f"{shared_dir(spark)}/s6-{uuid.uuid4().hex}"
    rosters.save_roster(c.drop("c_mktsegment"), folder)
    rosters.save_roster(c.where("dest % 3 = 0 AND ord % 2 = 0").select("dest", "ord", F.col("c_mktsegment").alias("name_en")), folder)
    return spark.read.parquet(folder).select("dest", "ord", "name_en")


@query("s4_roster_rows", "SELECT c_name AS name_en, '' AS name_ja, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE '' END AS gender, c_mktsegment AS alias_en, '' AS alias_ja FROM customer")
def s4(spark, d):
    c = read(spark, d, "customer").selectExpr("c_custkey AS ord", "c_name AS name_en", "CAST(NULL AS STRING) AS name_ja", "CASE WHEN c_custkey % 2 = 0 THEN 'male' END AS gender", "c_mktsegment AS alias_en", "CAST(NULL AS STRING) AS alias_ja")
    return rosters.roster_rows(c)


_ROW = "'{\"meta_id\":\"c' || c_custkey || '\",\"name_en\":\"' || c_name || '\",\"name_ja\":null,\"gender\":' || CASE WHEN c_custkey % 10 = 3 THEN '\"x\"' ELSE '\"male\"' END || ',\"alias_en\":null,\"alias_ja\":null}'"


@query("s5_roster_documents", "SELECT c_custkey % 100 AS path, count(*) AS n FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 100 % 9 <> 0 GROUP BY 1")
def s5(spark, d):
    rows = read(spark, d, "customer").select((F.col("c_custkey") % 100).alias("path"), F.expr(_ROW).alias("r"))
    version = F.when(F.col("path") % 9 == 0, "2").otherwise("1")
    docs = rows.groupBy("path").agg(F.concat_ws(",", F.collect_list("r")).alias("rs")).select("path", F.concat(F.lit('{"version":'), version, F.lit(',"characters":['), "rs", F.lit("]}")).alias("raw"))
    return rosters.roster_documents(docs, most=1_000_000)[0].groupBy("path").agg(F.count("*").alias("n"))


@query("s7_checksums", "SELECT p_name || p_partkey AS name, sha256(p_partkey::VARCHAR) AS sha256 FROM part WHERE p_partkey % 4 < 2")
def s7(spark, d):
    digest = F.sha2(F.col("p_partkey").cast("string"), 256)
    name = F.concat("p_name", "p_partkey")
    line = F.expr("p_partkey % 4")
    text = F.when(line == 0, F.concat(digest, F.lit("  "), name)).when(line == 1, F.concat(F.lit("SHA256 ("), name, F.lit(") = "), digest)).when(line == 2, "").otherwise(F.concat(F.lit("? "), name))
    return rosters.parse_checksums(read(spark, d, "part").select(text.alias("value")))[0]
