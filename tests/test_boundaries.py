"""Boundaries of single operators on literal rows, and streams against their batch twins."""

import pathlib
import random
import re

from pyspark.sql import functions as F

from quirefold.functions import colour, geometry, layout, payload, text
from quirefold.operators import aggregate, graph, hooks, joins, order
from quirefold.sources import rosters
from quirefold.streaming import pacing, state


def one(spark, col, **values):
    names = list(values)
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(col.alias("v")).first()["v"] if names else spark.range(1).select(col.alias("v")).first()["v"]


def test_nothing_else_imports_llm():
    root = pathlib.Path(__file__).resolve().parents[1]
    for path in (root / "quirefold").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(?:from|import) quirefold\.llm|corpus_pipeline", path.read_text()), path


def test_text_guards(spark):
    lit = F.lit
    assert one(spark, text.clean_name(lit("  <|im_start|>A  B<think> "))) == "A B"
    assert one(spark, text.clean_name(lit("<think> "))) is None
    assert len(one(spark, text.clean_name(lit("x" * 300)))) == 100
    assert one(spark, text.num_or(lit("nan"), 0, 9, 4)) == 4
    assert one(spark, text.num_or(lit("2.5"), 0, 9, 4)) == 2
    assert one(spark, text.num_or(lit("2.5"), 0, 9, 4, "up")) == 3
    assert one(spark, text.bool_or(lit(" ON "))) is True and one(spark, text.bool_or(lit("maybe"))) is None
    assert one(spark, text.redact(lit("see https://u:p@h/x?k=1\nBearer abc"))) == "see https://[redacted]@h/x?[redacted]\\nBearer [redacted]"
    assert one(spark, text.clean_reply(lit("<think>x"), lit(""))) is None
    assert one(spark, text.clean_reply(lit('"a" and "b"'), lit("s"))) == '"a" and "b"'
    assert one(spark, text.clean_reply(lit('"ab"'), lit("s"))) == "ab"
    assert one(spark, text.split_speaker(lit("[a]: [b]: hi")))["tag"] == "b"
    assert one(spark, text.version_key(lit("1.2.3-rc")) < text.version_key(lit("1.2.3"))) is True
    assert one(spark, text.version_key(lit("1.2.3+b")) == text.version_key(lit("1.2.3"))) is True
    assert one(spark, text.natural_key(lit("P2")) < text.natural_key(lit("p10"))) is True
    assert one(spark, text.safe_name(lit("a/b"))) is False


def test_colour_and_geometry(spark):
    assert tuple(one(spark, colour.parse_colour(F.lit("#0f8")))) == (0, 255, 136, 255)
    assert tuple(one(spark, colour.parse_colour(F.lit("red")))) == (0, 0, 0, 255)
    p = geometry.rect_points(F.lit(5), F.lit(5), F.lit(-3), F.lit(2))
    assert one(spark, geometry.polygon_area(p)) == 6.0
    assert one(spark, geometry.polygon_area(F.slice(p, 1, 2))) == 0.0
    assert one(spark, geometry.shift_inside(F.lit(-3.5), F.lit(2000.0), F.lit(900.0))) == 0
    assert one(spark, geometry.iou(*({k: F.lit(0.0) for k in ("x1", "y1", "x2", "y2")} for _ in "ab"))) == 0.0


def test_wrap_and_fit(spark):
    assert one(spark, layout.wrap(F.lit("tot-al a--b\r\n\r\nover-long-word -x"), F.lit(8.0))) == ["tot-al", "a--b", "", "over-", "long-", "word", "-x"]
    df = spark.createDataFrame([(1, "aa bb cc", 40.0, 40.0), (2, "unbreakable" * 9, 20.0, 20.0)], "k int, t string, w double, h double")
    sizes = dict(layout.fit_size(df, "k", "t", "w", "h").collect())
    assert sizes[2] is None and 6 <= sizes[1] < 40


def test_components_and_suppression(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(7, 7), (None, 3)]
    parent = {i: i for i in range(501)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = dict(graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {n: root(n) for e in edges if None not in e and e[0] != e[1] for n in e}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    boxes = [(1, i, x := float(rng.randrange(300)), y := float(rng.randrange(300)), x + rng.randrange(1, 90), y + rng.randrange(1, 90), rng.randrange(40) / 40) for i in range(150)]
    kept: list = []

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        if w <= 0 or h <= 0:
            return 0
        return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)

    for b in sorted((b for b in boxes if b[6] > 0.25), key=lambda b: (-b[6], b[1])):
        if all(iou(a, b) <= 0.3 for a in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "page int, id int, x1 double, y1 double, x2 double, y2 double, score double")
    got = joins.suppress(df, "page", "id", iou=0.3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [b[1] for b in kept]


def test_votes_and_ties(spark):
    boxes = spark.createDataFrame([(1, 1, 10.0, 10.0, 10.0, 13.0), (1, 2, 40.0, 10.0, 13.0, 10.0), (2, 3, 5.0, 5.0, 10.0, 11.0)], "page int, id int, x double, y double, w double, h double")
    assert dict(order.orientation(boxes, "page").collect()) == {1: "horizontal", 2: "vertical"}
    prob = spark.createDataFrame([(1, 0, 0, 0, 0.9), (1, 0, 1, 0, 0.9), (1, 0, 1, 1, 0.8)], "page int, y int, x int, scale int, p double")
    assert {(r["x"], r["agreed"]) for r in aggregate.merge_scales(prob, ["page", "y", "x"]).collect()} == {(0, None), (1, True)}
    steps = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 5, 0.9), (1, 3, 0, 1.0), (1, 4, 5, 0.7), (2, 1, 0, 1.0)], "g int, seq int, token int, p double")
    got = {r["g"]: (r["tokens"], r["score"]) for r in aggregate.collapse_tokens(steps, "g", "seq").collect()}
    assert got[1][0] == [5, 5] and abs(got[1][1] - 0.6) < 1e-9 and got[2] == ([], None)


def test_edits_are_refused(spark):
    roster = spark.createDataFrame([("a", 1, "A", None, None, None, None)], "meta_id string, ord int, name_en string, name_ja string, gender string, alias_en string, alias_ja string")
    edits = spark.createDataFrame([("a", 1, "update", {"name_en": " "}), ("b", 2, "add", {}), ("c", 3, "add", {"name_en": "C"}), ("d", 4, "update", {"name_en": "D"})], "meta_id string, seq int, op string, fields map<string,string>")
    good, refused = joins.apply_edits(roster, edits)
    assert [r["meta_id"] for r in good.collect()] == ["c"]
    assert {r["meta_id"] for r in refused.collect()} == {"a", "b", "d"}


def test_sealed_values(spark):
    df = spark.createDataFrame([("x", "secret"), ("y", None)], "k string, v string")
    sealed = payload.seal(df, ["v"], F.lit("0123456789abcdef"))
    rows = {r["k"]: r["v"] for r in sealed.collect()}
    assert rows["y"] is None and "secret" not in rows["x"]
    wrong, right = F.lit("fedcba9876543210"), F.lit("0123456789abcdef")
    opened = sealed.select("k", payload.open_sealed(sealed, "v", [wrong, right]).alias("v"), payload.open_sealed(sealed, "v", [wrong]).alias("w"))
    assert {(r["k"], r["v"], r["w"]) for r in opened.collect()} == {("x", "secret", None), ("y", None, None)}


def test_alternatives_are_opened_then_deduplicated(spark):
    lost, old, new = (F.lit(x * 16) for x in "abc")
    rows = [(1, 0, "one"), (1, 1, "two"), (1, 2, "one"), (1, 3, "gone"), (1, 4, None), (1, 5, ""), (2, 0, "gone")]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    key = F.when(F.col("v") == "gone", lost).when(F.col("i") % 2 == 0, old).otherwise(new)
    sealed = payload.seal(df, ["v"], key).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a"))
    sealed = sealed.select("k", F.transform("a", lambda x: x["v"]).alias("a")).unionByName(spark.createDataFrame([(3, None)], "k int, a array<string>"))
    got = {r["k"]: r["o"] for r in sealed.select("k", payload.open_alternatives(sealed, "a", [new, old], 60).alias("o")).collect()}
    assert got == {1: ["one", "two"], 2: [], 3: []}


def test_a_full_roster_refuses_the_rest(spark):
    fields = "name_en string, name_ja string, gender string, alias_en string, alias_ja string"
    roster = spark.createDataFrame([(f"m{i:02}", i, f"N{i}", None, None, None, None) for i in range(45)], f"meta_id string, ord int, {fields}")
    edits = spark.createDataFrame([(f"new{i:02}", i, "add", {"name_en": f"X{i}"}) for i in range(20)], "meta_id string, seq int, op string, fields map<string,string>")
    good, refused = joins.apply_edits(roster, edits)
    kept = good.orderBy("ord").collect()
    assert [r["ord"] for r in kept] == list(range(1, 51)) and [r["meta_id"] for r in kept[45:]] == [f"new{i:02}" for i in range(5)]
    assert {(r["meta_id"], r["reason"]) for r in refused.collect()} == {(f"new{i:02}", "refused: full") for i in range(5, 20)}


def test_roster_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.csv").write_text("﻿ Name_EN ,extra,GENDER\nAnn<think>,1,Male\n , ,\nBob,2,robot\n", encoding="utf-8")
    got = rosters.read_roster_csv(spark, str(tmp_path / "in"), "de").orderBy("ord").collect()
    assert [(r["ord"], r["name_en"], r["gender"]) for r in got] == [(1, "Ann", "male"), (2, "Bob", None)]
    roster = rosters.read_roster_csv(spark, str(tmp_path / "in"), "de")
    rosters.write_roster_csv(roster, str(tmp_path / "out"))
    assert rosters.read_roster_csv(spark, str(tmp_path / "out"), "de").count() == 2
    for dest in ("de", "fr"):
        rosters.save_roster(roster.withColumn("dest", F.lit(dest)), str(tmp_path / "store"))
    rosters.save_roster(roster.where("ord = 1").withColumn("dest", F.lit("fr")), str(tmp_path / "store"))
    assert {(r["dest"], r["count"]) for r in spark.read.parquet(str(tmp_path / "store")).groupBy("dest").count().collect()} == {("de", 2), ("fr", 1)}


def test_hooks_record_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, image string")

    def broken():
        raise RuntimeError("no model")

    got = hooks.recognise(df, broken, lambda: lambda v: [x * 2 for x in v]).orderBy("id").collect()
    assert [(r["text"], r["engine"]) for r in got] == [("aa", "fallback"), ("bb", "fallback")]
    assert all(r["text"] is None and "no model" in r["error"] for r in hooks.recognise(df, broken).collect())
    seen = hooks.translate_in_order(df.withColumn("page", F.lit(1)), lambda: lambda t, before: t + str(len(before)), "page", "id", "image")
    assert [r["data"] for r in seen.orderBy("id").collect()] == ["a0", "b1"]


def _stream(spark, df, path, build, name, mode):
    df.coalesce(1).write.parquet(str(path / "src"))
    source = spark.readStream.schema(df.schema).parquet(str(path / "src"))
    q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from quirefold.plans import event_queries as E

    d = "/root/testdata/sf0.001"
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir(), (tmp_path / "c").mkdir(), (tmp_path / "d").mkdir()
    tasks = E.task_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = _stream(spark, tasks, tmp_path / "a", lambda s: state.task_state(s, delay="400 days"), "tasks", "update")
    want = state.task_state_batch(tasks)
    cols = ["task", "started", "done", "lines", "last_line", "status"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    moves = E.transfer_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = _stream(spark, moves, tmp_path / "b", lambda s: state.transfer_state(s, delay="400 days"), "transfers", "update")
    cols = ["job", "file", "count", "total", "phase"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, state.transfer_state_batch(moves).select(cols).collect()))
    batches = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS client", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS batch", "CAST(floor(value) % 13 AS INT) AS events")
    got = _stream(spark, batches, tmp_path / "c", lambda s: state.admit(s, span=86400.0, delay="400 days"), "admitted", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.admit_batch(batches, span=86400.0).collect()))
    events = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type = 'purchase' AS forced")
    got = _stream(spark, events, tmp_path / "d", lambda s: state.throttle(s, "user_id", "ts", "forced", gap=3600.0, delay="400 days"), "throttled", "append")
    twin = pacing.throttle_batch(events.withColumn("s", F.unix_micros("ts") / 1e6), "user_id", "event_id", "s", "forced", gap=3600.0)
    assert got.count() == twin.count()


def test_trimming_order(spark):
    roster = [("a", "Ann"), ("b", "Bob"), ("c", "Cid")]
    pairs = [("s1" * 50, "e1" * 50, "b"), ("s2", "e2", None)]
    schema = "req_id long, text string, speaker string, pairs array<struct<source:string,english:string,speaker:string>>, roster array<struct<meta_id:string,name:string>>"
    rows = spark.createDataFrame([(1, "hi Cid", "a", pairs, roster), (2, "x" * 500, "a", [], roster)], schema)

    def trimmed(budget):
        return {r["req_id"]: r for r in order.trim_request(rows, n_ctx=budget + 4, max_new=0).collect()}

    assert trimmed(347)[1]["kept_pairs"] == 2  # costs 347: everything fits
    assert (trimmed(346)[1]["kept_pairs"], trimmed(346)[1]["kept_roster"]) == (1, ["a", "b", "c"])  # Bob speaks in the oldest pair: it goes first; rows stay in roster order
    tight = trimmed(140)[1]
    assert (tight["kept_pairs"], tight["kept_roster"], tight["cost"], tight["error"]) == (0, ["a", "c"], 140, None)
    assert trimmed(140)[2]["error"] == "does not fit"
