"""A uniform shuffle into shards of exact sizes through a communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.plans.session import materialise

#: About so many rows are ordered in one task.
BLOCK_ROWS = 50_000
#: A drawn table of at most so many numbers is broadcast; beyond, joins are by merging.
BROADCAST_NUMBERS = 200_000
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without return from ``good + bad`` are good.

    Beyond the sizes numpy takes, the distribution is inverted outwards from its mode.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    if good < _NUMPY_LIMIT and bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    log_p = (
        lg(good + 1) - lg(mode + 1) - lg(good - mode + 1)
        + lg(bad + 1) - lg(draws - mode + 1) - lg(bad - draws + mode + 1)
        - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1)
    )
    u = rng.random()
    up, down, p_up, p_down = mode, mode, math.exp(log_p), math.exp(log_p)
    u -= p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each shard in a uniformly random shuffle.

    Row sums are ``block_rows``, column sums ``shard_rows``; each entry is drawn from
    its distribution given those before it.
    """
    rng = np.random.default_rng(seed)
    room = list(shard_rows)
    out = np.zeros((len(block_rows), len(shard_rows)), dtype=np.int64)
    for b, rows in enumerate(block_rows):
        rest_room = sum(room)
        for s in range(len(room)):
            rest_room -= room[s]
            take = hypergeometric(rng, room[s], rest_room, rows)
            out[b, s] = take
            room[s] -= take
            rows -= take
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _unit(h: Column) -> Column:
    return F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))


def _hint(numbers: int) -> str:
    return "broadcast" if numbers <= BROADCAST_NUMBERS else "merge"


def _numbered(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``rows`` with ``__nth``: 0 for rows that are unlike all others, 0 to n - 1 over n equal ones.

    Equal rows are numbered inside each task's part of them, after as many as earlier parts
    hold, so that no number of copies comes together in one task. Which of them gets which
    number depends on the parts, but not what numbers there are.
    """
    key = ["__first", "__second"]
    order = Window.partitionBy(*key).orderBy("__part")
    held = rows.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    held = held.withColumn("__before", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    held = held.withColumn("__all", F.sum("__n").over(Window.partitionBy(*key)))
    held = held.where("__all > 1").select(*key, "__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    joined = rows.join(held.hint("merge"), [*key, "__part"], "left")
    local = F.row_number().over(Window.partitionBy(*key, "__part").orderBy(*by))
    repeated = joined.where("__before IS NOT NULL").withColumn("__nth", F.col("__before") + local - 1)
    return joined.where("__before IS NULL").withColumn("__nth", F.lit(0).cast("long")).unionByName(repeated)


def shard(docs: DataFrame, shards: int = 8, keys: list[str] | None = None, seed: int = 11) -> DataFrame:
    """``docs`` in a uniformly random order over ``shards`` shards: adds ``shard, slot``.

    Shard sizes differ by one at most and slots run from 0 without gaps. Rows are
    dealt by a hash into blocks, which stand for the sending partitions and, unlike these,
    are the same in each run; how many rows each block sends to each shard is drawn
    from the hypergeometric law (blocks x shards numbers, a block for ``BLOCK_ROWS``
    rows, are all that the driver holds; a large table of them is joined by merging). Each
    block permutes its rows and cuts them at those counts, rows are exchanged, and each
    shard permutes what it got: in cells of about ``BLOCK_ROWS`` rows by leading bits of a
    second hash, with the cells' counts summed to offsets, so that no shard is ordered in
    one task.

    Hashes are of ``keys`` (default: all columns) and, for rows equal in them, of a running
    number, so reruns agree; equal rows are interchangeable and spread like others, over
    blocks too. Nulls are values like others, an empty table gives none, existing ``shard``
    and ``slot`` columns are replaced. Every column of ``docs`` moves: select narrow columns
    first where texts are to stay.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    by = [F.col(f"`{c}`") for c in (keys or names)]
    spark = docs.sparkSession
    rows = materialise(
        docs.select(
            *(F.col(f"`{c}`") for c in names),
            F.xxhash64(F.lit(seed), *by).alias("__first"),
            F.xxhash64(F.lit(seed + 1), *by).alias("__second"),
            F.spark_partition_id().alias("__part"),
        ),
        "shard-rows",
    )
    total = rows.count()
    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    rows = _numbered(rows, by).withColumns(
        {"__first": F.xxhash64("__first", "__nth"), "__second": F.xxhash64("__second", "__nth")}
    )
    rows = rows.withColumn("__block", F.pmod(F.col("__first"), F.lit(blocks)).cast("int"))
    rows = materialise(rows.drop("__part", "__before", "__nth"), "shard-blocks")
    counts = {r["__block"]: r["n"] for r in rows.groupBy("__block").agg(F.count("*").alias("n")).collect()}
    block_rows = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(block_rows, shard_sizes(total, shards), seed)
    ends = spark.createDataFrame(
        [(b, row) for b, row in enumerate(np.cumsum(matrix, axis=1).tolist())], "__b int, __ends array<long>"
    )
    local = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed + 2), "__first"), "__second", *by)
    sent = (
        rows.withColumn("__rank", F.row_number().over(local))
        .join(ends.hint(_hint(blocks * shards)), F.expr("__block = __b"))
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rank"))).cast("int"))
    )
    cells = max(1, math.ceil(total / shards / BLOCK_ROWS))
    sent = sent.withColumn("__cell", F.floor(_unit(F.col("__second")) * cells).cast("int"))
    sent = materialise(sent.drop("__rank", "__b", "__ends", "__block"), "shard-sent")
    held = sent.groupBy("shard", "__cell").agg(F.count("*").alias("n")).orderBy("shard", "__cell").collect()
    offsets, at = [], {}
    for r in held:
        offsets.append((r["shard"], r["__cell"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    starts = spark.createDataFrame(offsets, "__s int, __c int, __offset long")
    again = Window.partitionBy("shard", "__cell").orderBy("__second", "__first", *by)
    placed = sent.withColumn("__nth", F.row_number().over(again)).join(
        starts.hint(_hint(3 * len(offsets))), F.expr("shard = __s AND __cell = __c")
    )
    return placed.select(*(F.col(f"`{c}`") for c in names), "shard", (F.col("__offset") + F.col("__nth") - 1).alias("slot"))
