"""T3 over a table: what a throttle publishes, by successor pointers instead of a loop over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.plans.session import materialise


def _carried(rows: DataFrame, key: str, value: str, take: str) -> DataFrame:
    """``rows`` (with ``__part``) and ``__before``: the last (``take`` = last) or greatest (max) ``value`` of the
    key's rows in earlier parts. One row a part and key is gathered, so a key that fills every part gives
    as many rows as there are parts."""
    chosen = F.max_by(value, F.struct("__t", "__id")) if take == "last" else F.max(value)
    ends = rows.groupBy(key, "__part").agg(chosen.alias("end"))
    order = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    over = F.last("end", ignorenulls=True) if take == "last" else F.max("end")
    ends = ends.select(F.col(key).alias("__k"), F.col("__part").alias("__p"), over.over(order).alias("__before"))
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p"))
    return rows.hint("merge").join(ends, same, "left").drop("__k", "__p")


def throttle_batch(events: DataFrame, key: str, order: str, at: str, forced: str, gap: float = 0.25) -> DataFrame:
    """T3, batch twin: ``key, order`` of events that are published: forced, or ``gap`` seconds after the last one published.

    Events are taken in order of their time (to the microsecond), then ``order``, as a clock gives
    them. A null ``forced`` counts as not forced; an event without a time is published only
    if forced and moves nothing.

    Forced events, a key's first, and those ``gap`` after their predecessor are published
    whatever came before: they begin bursts. Within a burst each event points at the first one
    ``gap`` later, found by a sorted merge in spans of ``gap`` seconds: it lies in the span of
    that time or, as events are closer than a span, in the next. From the bursts' beginnings the
    pointers are followed by doubling, so rounds grow with the logarithm of the events that one
    burst publishes. Rows are dealt by ranges of key and time and by spans, never by key alone.
    """
    micros = F.round(F.col(at).cast("double") * 1_000_000).cast("long")
    wide = int(round(gap * 1_000_000))
    rows = events.select(key, order, micros.alias("__t"), F.coalesce(F.col(forced), F.lit(False)).alias("__forced"))
    rows = materialise(rows.withColumn("__id", F.monotonically_increasing_id()), "pacing-rows")
    untimed = rows.where(F.col("__t").isNull() & F.col("__forced")).select(key, order)
    timed = rows.where(F.col("__t").isNotNull())

    # the time before, then whether a burst begins
    dealt = timed.repartitionByRange(key, "__t", order, "__id").withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "pacing-parts")
    line = Window.partitionBy(key, "__part").orderBy("__t", order, "__id")
    dealt = _carried(dealt, key, "__t", "last").withColumn("__prev", F.coalesce(F.lag("__t").over(line), F.col("__before")))
    begins = F.col("__forced") | F.col("__prev").isNull() | (F.col("__t") - F.col("__prev") >= wide)
    place = F.struct("__t", order, "__id")
    dealt = materialise(dealt.withColumn("__begin", F.when(begins, place)).drop("__before", "__prev"), "pacing-begun")
    dealt = _carried(dealt, key, "__begin", "max")
    burst = F.coalesce(F.max("__begin").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before"))
    span = F.floor((F.col("__t") - burst["__t"]) / wide).cast("long") if wide else F.lit(0).cast("long")
    dealt = dealt.select(key, order, "__t", "__id", F.col("__begin").isNotNull().alias("__first"), burst["__id"].alias("__burst"), span.alias("__span"))
    dealt = materialise(dealt, "pacing-bursts")

    # the first event a gap later, in this span of the burst or the next
    asks = dealt.select("__burst", (F.col("__span") + 1).alias("__span"), (F.col("__t") + wide).alias("__t"), F.col("__id").alias("ask"))
    there = dealt.select("__burst", "__span", "__t", order, F.col("__id").alias("id"))
    both = there.withColumn("ask", F.lit(None).cast("long")).unionByName(asks, allowMissingColumns=True)
    # downwards, so that what is met last is the first at or after an ask's time; at equal times asks come last
    down = Window.partitionBy("__burst", "__span").orderBy(F.desc("__t"), F.col("ask").isNotNull(), F.desc(order), F.desc("id"))
    met = F.last("id", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("next", met).where("ask IS NOT NULL").select("__burst", "__span", "ask", "next")
    heads = there.groupBy("__burst", (F.col("__span") - 1).alias("__span")).agg(F.min_by("id", F.struct("__t", order, "id")).alias("head"))
    found = found.hint("merge").join(heads, ["__burst", "__span"], "left")
    point = found.select(F.col("ask").alias("id"), F.coalesce("next", "head").alias("to")).where("to IS NOT NULL")

    point = materialise(point, "pacing-pointers")
    goes = materialise(dealt.where("__first").select(F.col("__id").alias("id")), "pacing-published")
    while True:
        new = materialise(goes.hint("merge").join(point, "id").select(F.col("to").alias("id")), "pacing-new")
        if new.isEmpty():
            break
        goes = materialise(goes.unionAll(new), "pacing-published")
        on = point.select(F.col("id").alias("to"), F.col("to").alias("end"))
        point = materialise(point.hint("merge").join(on, "to").select("id", F.col("end").alias("to")), "pacing-pointers")
    out = dealt.hint("merge").join(goes.withColumnRenamed("id", "__id"), "__id", "left_semi").select(key, order)
    return out.unionAll(untimed)
