"""Live state of tasks and transfers: streaming operators and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor

from quirefold.plans.session import ship_package
from quirefold.streaming.processors import Admission, TaskRuns, Throttle, Transfers

#: Fixed value: the state store that processors with timers and lists need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINES = 60
EXPIRY_S = 30


def task_state_batch(events: DataFrame, keep: int = LINES) -> DataFrame:
    """T1, batch twin: per task its latest run from ``ts, seq, task, kind, done, total, line``.

    A start replaces any run before it; events before the first start count as a run
    of their own. ``lines`` is how many messages the run kept, ``status`` running,
    finished or failed; events after the end are dropped (T5).
    """
    w = Window.partitionBy("task").orderBy("seq")
    runs = events.withColumn("run", F.sum((F.col("kind") == "start").cast("int")).over(w))
    last = runs.groupBy("task").agg(F.max("run").alias("run"))
    now = runs.join(last.hint("merge"), ["task", "run"])
    ended = F.coalesce(F.max(F.col("kind").isin("finish", "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = now.withColumn("__ended", ended).where("__ended = 0")
    closing = F.col("kind") == "finish"  # its line may be one more
    return live.groupBy("task").agg(
        F.min("ts").alias("started"), F.max("ts").alias("updated"), F.max_by("done", F.when(F.col("done").isNotNull(), F.col("seq"))).alias("done"),
        F.max_by("total", F.when(F.col("total").isNotNull(), F.col("seq"))).alias("total"),
        (F.least(F.count_if(F.col("line").isNotNull() & ~closing), F.lit(keep)) + F.count_if(F.col("line").isNotNull() & closing)).alias("lines"), F.max_by("line", F.when(F.col("line").isNotNull(), F.col("seq"))).alias("last_line"),
        F.when(F.max_by("kind", "seq") == "finish", "finished").when(F.max_by("kind", "seq") == "error", "failed").otherwise("running").alias("status"),
    )


def _stateful(events: DataFrame, delay: str, at: str, by: list[str], processor: StatefulProcessor, out: str, mode: str) -> DataFrame:
    """``events`` through a processor by key. Such state is kept in RocksDB, so its provider is set on the session."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship_package(spark)
    return events.withWatermark(at, delay).groupBy(*by).transformWithState(processor, out, mode, "eventTime")


def task_state(events: DataFrame, delay: str = "1 minute", keep: int = LINES, expiry_s: int = EXPIRY_S, mark_s: int = 86400) -> DataFrame:
    """T1, streaming: a snapshot of each task that had events in a batch (update mode).

    State holds one run a task and its last ``keep`` lines. Finished tasks go ``expiry_s``
    of event time after the end; late events are cut by the watermark, those of an expired
    run by a mark that stays ``mark_s``.
    """
    out = "task string, started timestamp, updated timestamp, done long, total long, lines long, last_line string, status string"
    return _stateful(events, delay, "ts", ["task"], TaskRuns(keep, expiry_s, mark_s), out, "update")


def transfer_state_batch(events: DataFrame) -> DataFrame:
    """T2, batch twin: per (job, file) the bytes of its newest attempt, from
    ``seq, job, file, attempt, kind (start, advance, finish), amount, start, total``.

    An attempt replaces the count by its own start and adds what it moved; events after a
    finish are ignored; a finish sets count and total to its amount.
    """
    keys = ["job", "file"]
    w = Window.partitionBy(*keys).orderBy("seq")
    over = F.coalesce(F.max((F.col("kind") == "finish").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = events.withColumn("__over", over).where("__over = 0")
    newest = live.groupBy(*keys).agg(F.max("attempt").alias("attempt"))
    rows = live.join(newest.hint("merge"), [*keys, "attempt"])
    moved = F.coalesce(F.sum(F.when(F.col("kind") == "advance", F.col("amount"))), F.lit(0))
    size = F.max(F.when(F.col("kind") == "finish", F.col("amount")))
    return rows.groupBy(*keys).agg(
        F.coalesce(size, F.coalesce(F.max("start"), F.lit(0)) + moved).alias("count"), F.coalesce(size, F.max("total")).alias("total"),
        F.when(size.isNotNull(), "finalizing").when(moved > 0, "downloading").otherwise("preparing").alias("phase"),
    )


def transfer_state(events: DataFrame, delay: str = "1 minute", expiry_s: int = 3600) -> DataFrame:
    """T2, streaming: state of each (job, file) that had events in a batch (update mode), kept ``expiry_s`` after the last."""
    out = "job string, file string, count long, total long, phase string"
    return _stateful(events, delay, "ts", ["job", "file"], Transfers(expiry_s), out, "update")


def in_order(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, Any]], out: str, kind: T.DataType | None = None) -> DataFrame:
    """``rows`` with ``out``, a boolean or of ``kind``: what ``step(state, row)`` gives for each, key by key in ``order``.

    Rows of a key are sorted by Spark and pass one at a time, so a task holds the state of
    one key and never its rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, kind or T.BooleanType())])
    arrow = to_arrow_type(kind or T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            columns = batch.to_pydict()
            names, got = list(columns), []
            for values in zip(*columns.values(), strict=True):
                row = dict(zip(names, values, strict=True))
                if state is None or row[key] != now:
                    now, state = row[key], start()
                state, value = step(state, row)
                got.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], names=[*names, out])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def throttle(events: DataFrame, key: str, at: str, forced: str, gap: float = 0.25, delay: str = "1 minute") -> DataFrame:
    """T3, streaming (append): events that ``pacing.throttle_batch`` publishes, with the last published time of each key as state."""
    kind = events.schema[key].dataType.simpleString()
    return _stateful(events, delay, at, [key], Throttle(key, at, forced, gap), f"`{key}` {kind}, `{at}` timestamp", "append")


def admit_batch(batches: DataFrame, client: str = "client", limit: int = 60, span: float = 60.0, most: int = 10) -> DataFrame:
    """T4, batch twin: ``client, batch, admitted`` of batches (``ts, batch, events``).

    A batch of over ``most`` events, or that would make more than ``limit`` admitted ones
    in the last ``span`` seconds, is refused and uses no budget. Each client's batches pass in
    order of time and name; only admitted batches of the last span are remembered. A batch
    without a time or a count is refused.
    """
    rows = batches.select(client, "batch", F.unix_micros(F.col("ts").cast("timestamp")).alias("__at"), F.col("events").cast("long").alias("__n"))

    def step(held: list, row: dict) -> tuple:
        now, n = row["__at"], row["__n"]
        if now is None or n is None:
            return held, False
        held = [(t, k) for t, k in held if now - t < span * 1e6]
        good = n <= most and sum(k for _, k in held) + n <= limit
        return ([*held, (now, n)] if good else held), good

    return in_order(rows, client, ["__at", "batch"], list, step, "admitted").select(client, "batch", "admitted")


def late_events(events: DataFrame, task: str = "task", order: str = "seq", kind: str = "kind") -> DataFrame:
    """T5, batch twin: the events that T1 drops: those after a finish or an error of their run.

    A start begins a new run, so it is never late. Events before the first start are a run
    of their own.
    """
    w = Window.partitionBy(task).orderBy(order)
    runs = events.withColumn("__run", F.sum((F.col(kind) == "start").cast("int")).over(w))
    before = Window.partitionBy(task, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col(kind).isin("finish", "error")).over(before)
    return runs.withColumn("__late", F.coalesce(ended, F.lit(False))).where("__late").drop("__run", "__late")


def admit(batches: DataFrame, client: str = "client", limit: int = 60, span: float = 60.0, most: int = 10, delay: str = "1 minute") -> DataFrame:
    """T4, streaming (append): the same, with the admitted batches of the last span as state."""
    kinds = {c: batches.schema[c].dataType.simpleString() for c in (client, "batch")}
    schema = f"`{client}` {kinds[client]}, batch {kinds['batch']}, admitted boolean"
    return _stateful(batches, delay, "ts", [client], Admission(client, limit, span, most), schema, "append")
