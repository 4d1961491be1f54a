"""Streams over several micro-batches: state carried on, timers, expiry, late events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirefold.streaming import pacing, state

BEGAN = datetime(2024, 1, 1)
TASKS = "ts timestamp, seq long, task string, kind string, done long, total long, line string"


def at(seconds):
    return BEGAN + timedelta(seconds=seconds)


def run(spark, path, batches, schema, build, mode):
    """The rows of each micro-batch, one file each, in the order given."""
    got = []

    def keep(df, batch):
        got.extend((batch, r) for r in df.collect())

    source = path / "src"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        live = build(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(source)))
        q = live.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
    return got


def test_finished_tasks_expire_and_late_events_go(spark, tmp_path):
    batches = [
        [(at(0), 1, "a", "start", None, 3, None), (at(1), 2, "a", "message", 1, None, "one"), (at(2), 3, "a", "finish", None, None, "done")],
        [(at(3), 4, "a", "message", 9, None, "late"), (at(20), 5, "b", "start", None, None, None)],
        [(at(100), 6, "b", "message", None, None, "on")],  # the watermark passes a's expiry
        [(at(110), 7, "a", "message", 5, None, "after expiry"), (at(111), 8, "b", "error", None, None, None)],
        [(at(120), 9, "a", "start", None, None, None), (at(121), 10, "a", "message", 2, None, "again")],
    ]
    got = run(spark, tmp_path, batches, TASKS, lambda s: state.task_state(s, delay="10 seconds"), "update")
    a = [r for _, r in got if r["task"] == "a"]
    assert [(r["done"], r["total"], r["lines"], r["last_line"], r["status"]) for r in a] == [(1, 3, 2, "done", "finished"), (2, None, 1, "again", "running")]
    b = [r["status"] for _, r in got if r["task"] == "b"]
    assert b == ["running", "running", "failed"]


def test_a_closing_line_may_be_one_more(spark, tmp_path):
    lines = [(at(i), i, "a", "message", i, None, f"line {i}") for i in range(70)]
    batches = [lines[:30], lines[30:], [(at(80), 80, "a", "finish", None, None, "closed")]]
    got = run(spark, tmp_path, batches, TASKS, lambda s: state.task_state(s, delay="1 hour"), "update")
    assert [r["lines"] for _, r in got] == [30, 60, 61]
    rows = spark.createDataFrame([r for b in batches for r in b], TASKS)
    assert state.task_state_batch(rows).first()["lines"] == 61


def test_attempts_replace_over_batches(spark, tmp_path):
    schema = "ts timestamp, seq long, job string, file string, attempt long, kind string, amount long, start long, total long"
    batches = [
        [(at(0), 1, "j", "f", 0, "start", None, 0, 100), (at(1), 2, "j", "f", 0, "advance", 40, None, None)],
        [(at(2), 3, "j", "f", 1, "start", None, 30, 100), (at(3), 4, "j", "f", 0, "advance", 99, None, None)],
        [(at(4), 5, "j", "f", 1, "advance", 20, None, None)],
        [(at(5), 6, "j", "f", 1, "finish", 100, None, None), (at(6), 7, "j", "f", 1, "advance", 5, None, None)],
    ]
    got = run(spark, tmp_path, batches, schema, lambda s: state.transfer_state(s, delay="1 hour"), "update")
    assert [(r["count"], r["total"], r["phase"]) for _, r in got] == [(40, 100, "downloading"), (30, 100, "preparing"), (50, 100, "downloading"), (100, 100, "finalizing")]


def test_throttle_and_admission_over_batches(spark, tmp_path):
    events = [(at(i * 0.1), "k" if i % 3 else "m", i % 17 == 0) for i in range(90)]
    batches = [events[:20], events[20:50], events[50:]]
    got = run(spark, tmp_path / "t", batches, "ts timestamp, key string, forced boolean", lambda s: state.throttle(s, "key", "ts", "forced", delay="1 hour"), "append")
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "seq int, ts timestamp, key string, forced boolean")
    twin = pacing.throttle_batch(rows.withColumn("s", F.unix_micros("ts") / 1e6), "key", "seq", "s", "forced")
    want = {(r["key"], events[r["seq"]][0]) for r in twin.collect()}
    assert {(r["key"], r["ts"]) for _, r in got} == want and len(got) == len(want) < 90

    asked = [(at(i * 2), "c" if i % 4 else "d", f"b{i:03}", i % 13) for i in range(120)]
    got = run(spark, tmp_path / "a", [asked[:50], asked[50:]], "ts timestamp, client string, batch string, events int", lambda s: state.admit(s, delay="1 hour"), "append")
    rows = spark.createDataFrame(asked, "ts timestamp, client string, batch string, events int")
    want = {tuple(r) for r in state.admit_batch(rows).collect()}
    assert {tuple(r) for _, r in got} == want and {r["admitted"] for _, r in got} == {True, False}


@pytest.mark.parametrize("kind", ["finish", "error"])
def test_a_mark_of_an_expired_run_goes_too(spark, tmp_path, kind):
    batches = [
        [(at(0), 1, "a", kind, None, None, "x"), (at(0), 2, "b", "start", None, None, None)],
        [(at(100), 3, "b", "message", None, None, None)],
        [(at(400), 4, "b", "message", None, None, None)],
        [(at(500), 5, "a", "message", 7, None, "new run")],
    ]
    got = run(spark, tmp_path, batches, TASKS, lambda s: state.task_state(s, delay="1 second", mark_s=60), "update")
    assert [(r["done"], r["status"]) for _, r in got if r["task"] == "a"] == [(None, "finished" if kind == "finish" else "failed"), (7, "running")]


def test_timers_are_kept_in_state_and_never_listed():
    from datetime import datetime

    from quirefold.streaming.processors import TaskRuns, Throttle, Transfers

    class State:
        value = None

        def get(self):
            return self.value if self.value is not None else iter(()) if self.many else None

        def exists(self):
            raise AssertionError("one message more")

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = set()

        def _state(self, many):
            s = State()
            s.many = many
            return s

        def getValueState(self, name, schema):
            return self._state(False)

        def getListState(self, name, schema):
            return self._state(True)

        def registerTimer(self, at):
            assert not self.timers
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    at = [datetime.fromtimestamp(100 * (i + 1)) for i in range(4)]
    for one, kinds in ((Transfers(5), ("advance", "advance", "finish", "advance")), (TaskRuns(3, 5, 9), ("finish", "start", "error", "start")), (Throttle("key", "ts", "forced", 1.0), (0, 0, 0, 0))):
        handle = Handle()
        one.init(handle)
        for i, kind in enumerate(kinds):
            row = {"ts": at[i], "seq": i, "kind": kind, "attempt": 1, "amount": 1, "start": None, "total": None, "done": None, "line": None, "forced": False}
            assert len(list(one.handleInputRows(("a", "b"), iter([row]), Now()))) == 1
        assert handle.timers == (set() if isinstance(one, TaskRuns) else {400_000 + (1000 if isinstance(one, Throttle) else 5000)})
