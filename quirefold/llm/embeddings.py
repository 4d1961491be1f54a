"""Embedding near-duplicates: sign hashes in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.operators.graph import connected_components
from quirefold.plans.session import materialise, ship_package

#: Vectors that meet in one block product at most.
BLOCK = 2048


def plan_tables(rows: int, threshold: float = 0.9, recall: float = 0.97, per_bucket: int = 512) -> tuple[int, int]:
    """(bits, tables): buckets of about ``per_bucket`` unrelated vectors, and as many
    tables as find a pair right at the threshold with probability ``recall``."""
    bits = max(4, min(24, round(math.log2(max(rows, 1) / per_bucket))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def planes(width: int, bits: int, tables: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, bits * tables))


def _local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows over links listed both ways."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
    recall: float = 0.97, seed: int = 5,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are linked at a cosine of ``threshold`` or more, computed in double
    precision. Candidates are pairs with the same signs against the random planes of
    one table at least; a pair is counted in the first table where it meets. Equal
    vectors are one class with a count from the start. A bucket is compared as matrix
    products of blocks of at most ``BLOCK`` classes, however many it holds, and gives
    counts per vector and the edges of its local components, never pairs.

    Vectors that are null, zero, of another length than most, or hold null or
    non-finite components link with nothing: n_links 0 and a component of their own.
    Rows that repeat an id are separate vectors that share it. An empty table gives none.
    """
    ship_package(vectors.sparkSession)
    v = F.col(vector_col)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(sound, F.transform(v, lambda x: x.cast("double") + F.lit(0.0))).alias("v"),
    )
    rows = materialise(rows, "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("width", F.size("v")), "vector-classes")
    common = classes.groupBy("width").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "width").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, total = common["width"], common["c"]
    classes = classes.where(F.col("width") == width).drop("width")
    bits, tables = plan_tables(total, threshold, recall)
    normal = planes(width, bits, tables, seed)
    powers = 1 << np.arange(bits)
    # what travels is no wider than what was given: 4 bytes a component where it was a float
    given = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(given, T.FloatType) else "<f8"

    @F.pandas_udf("sig array<int>, signs binary, body binary")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.to_list()) if len(batch) else np.zeros((0, width))
            given, x = x, x / np.abs(x).max(axis=1, initial=0.0)[:, None]
            sig = ((x @ normal > 0).reshape(len(x), tables, bits) * powers).sum(axis=2).astype("<i4")
            yield pd.DataFrame({"sig": sig.tolist(), "signs": [r.tobytes() for r in sig], "body": [r.tobytes() for r in given.astype(kind)]})

    hashed = materialise(classes.select("rep", "n", hashes("v").alias("h")).select("rep", "n", "h.*"), "vector-hashes")
    posted = hashed.select("rep", "n", "body", "signs", F.posexplode("sig").alias("t", "s"))
    sizes = hashed.select(F.posexplode("sig").alias("t", "s")).groupBy("t", "s").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select("t", "s", F.ceil(F.col("size") / (BLOCK // 2)).cast("int").alias("blocks"))
    met = posted.join(sizes.hint("merge"), ["t", "s"]).withColumn(
        "b", F.pmod(F.xxhash64("rep", "body"), F.col("blocks")).cast("int")
    )
    # each pair of blocks of a bucket is one group: a block goes to every group it is in
    grouped = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "t", "s", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"), "b", "rep", "n", "body", "signs"
    )

    def compare(group: pa.Table) -> pa.Table:
        t, b1, b2 = (group[c][0].as_py() for c in ("t", "b1", "b2"))
        group = group.sort_by([("rep", "ascending"), ("body", "ascending")])
        rep, n = group["rep"].to_numpy(), group["n"].to_numpy()
        x = np.frombuffer(b"".join(group["body"].to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)
        x /= np.abs(x).max(axis=1)[:, None]  # so that squares of very large and small components stay in range
        x /= np.linalg.norm(x, axis=1)[:, None]
        sig = np.frombuffer(b"".join(group["signs"].to_pylist()), dtype="<i4").reshape(-1, tables)
        close = x @ x.T >= threshold
        np.fill_diagonal(close, False)
        if b1 != b2:
            block = group["b"].to_numpy()
            close &= block[:, None] != block[None, :]
        # the links are few: what follows is on them, not on the square
        left, right = np.nonzero(close)
        root = _local_roots(len(rep), left, right)
        first = (sig[left, :t] != sig[right, :t]).all(axis=1)  # not counted in an earlier table
        links = np.bincount(left[first], weights=n[right[first]], minlength=len(rep)).astype(np.int64)
        used = (links > 0) | (root != np.arange(len(rep)))
        return pa.table({"rep": rep[used], "links": links[used], "root": rep[root[used]]})

    found = grouped.groupBy("t", "s", "b1", "b2").applyInArrow(compare, "rep long, links long, root long")
    found = materialise(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    placed = classes.join(counts.hint("merge"), "rep", "left").join(
        comps.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left"
    )
    placed = placed.select(
        "v",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    out = rows.join(placed.hint("merge"), "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
