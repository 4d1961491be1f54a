"""Masks as runs of cells in a row: union, intersection, dilation by an ellipse, clusters.

A run is ``page, y, x1, x2``, both ends in it. Everything here costs rows in proportion to the
runs of a mask, not to its cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.graph import connected_components
from quirefold.plans.session import materialise, ship_package, spread

#: Width of the strips of a row in which runs meet.
STRIP = 256
#: Side of the square tiles of a page in which a task links runs.
TILE = 1024
#: Runs that a task links at a time; a tile is not cut, and has half a run a cell at most.
CHUNK = 250_000


def runs(cells: DataFrame, page: str) -> DataFrame:
    """The runs of a mask's cells ``y, x``; cells given twice count once."""
    one = cells.select(page, "y", "x").distinct()
    start = F.col("x") - F.row_number().over(Window.partitionBy(page, "y").orderBy("x"))
    return one.withColumn("__run", start).groupBy(page, "y", "__run").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("__run")


def cells(mask: DataFrame, page: str) -> DataFrame:
    """The cells of a mask's runs."""
    return mask.select(page, "y", F.explode(F.sequence("x1", "x2")).alias("x"))


def merged(mask: DataFrame, page: str) -> DataFrame:
    """Runs that overlap or touch in a row as one: the union, whatever was given twice."""
    line = Window.partitionBy(page, "y").orderBy("x1", "x2")
    reached = F.max("x2").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("x1") > reached + 1, F.lit(True)).cast("int")
    rows = mask.select(page, "y", "x1", "x2").withColumn("__new", begins)
    rows = rows.withColumn("__run", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(page, "y", "__run").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("__run")


def union(page: str, *masks: DataFrame) -> DataFrame:
    out = masks[0].select(page, "y", "x1", "x2")
    for m in masks[1:]:
        out = out.unionByName(m.select(page, "y", "x1", "x2"))
    return merged(out, page)


def _stripped(mask: DataFrame, wide: int = 0) -> DataFrame:
    low, high = (F.floor(c / STRIP) for c in (F.col("x1") - wide, F.col("x2") + wide))
    return mask.withColumn("__strip", F.explode(F.sequence(low, high)))


def _meet(a: DataFrame, b: DataFrame, page: str, wide: int = 0) -> DataFrame:
    """Pairs of runs, as ``a`` and ``b``, of one row whose ends are ``wide`` apart at most beyond
    overlapping, each once, in the strip where the later of the two begins."""
    left = _stripped(a, wide).select(page, "y", "__strip", F.struct(*a.columns).alias("a"))
    right = _stripped(b).select(page, "y", "__strip", F.struct(*b.columns).alias("b"))
    met = left.hint("merge").join(right, [page, "y", "__strip"])
    met = met.where((F.col("a.x1") - wide <= F.col("b.x2")) & (F.col("b.x1") <= F.col("a.x2") + wide))
    return met.where(F.floor(F.greatest(F.col("a.x1") - wide, F.col("b.x1")) / STRIP) == F.col("__strip"))


def intersection(a: DataFrame, b: DataFrame, page: str) -> DataFrame:
    """What two masks share (U2); a page that one of them does not have shares nothing."""
    met = _meet(merged(a, page), merged(b, page), page)
    return met.select(page, "y", F.greatest("a.x1", "b.x1").alias("x1"), F.least("a.x2", "b.x2").alias("x2"))


def half_widths(gap: int) -> list[int]:
    """Of an ellipse of ``2 gap + 1`` cells each way: its half-width ``dy`` rows from the middle, rounded half to even."""
    return [round(math.sqrt(gap * gap - dy * dy)) for dy in range(gap + 1)]


def dilated(mask: DataFrame, page: str, gap: int) -> DataFrame:
    """A mask grown by an ellipse: each run widens by the half-width at each row offset, then runs are merged."""
    wide = half_widths(gap)
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(wide[abs(dy)]).alias("w")) for dy in range(-gap, gap + 1)))
    rows = mask.select(page, "y", "x1", "x2", F.explode(offsets).alias("o"))
    return merged(rows.select(page, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x1") - F.col("o.w")).alias("x1"), (F.col("x2") + F.col("o.w")).alias("x2")), page)


def reaches(gap: int) -> list[int]:
    """How far apart in their row two cells of one cluster are linked, by the rows between them from 0 to ``2 gap + 1``.

    The ellipses around two cells overlap or are neighbours if the cells are apart by an offset of the
    one, an offset of the other and a step to a neighbour together.
    """
    wide = half_widths(gap)
    both = [max(wide[abs(a)] + wide[abs(d - a)] for a in range(-gap, gap + 1) if abs(d - a) <= gap) for d in range(2 * gap + 1)]
    return [max(both[abs(d + e)] for e in (-1, 0, 1) if abs(d + e) <= 2 * gap) + 1 for d in range(2 * gap + 2)]


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each node reaches, once edges ``u, v`` are added to those behind ``root``."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _linker(gap: int, tile: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For runs sorted by tile, row and begin: each with the least cell that it reaches in its tile as ``root``."""
    wide = reaches(gap)
    reach = max(len(wide) - 1, *wide)
    side = tile + 2 * reach + 1
    high = side + len(wide)

    def begins(t: pa.Table) -> np.ndarray:
        keys = [t[c].to_numpy() for c in ("p", "ty", "tx")]
        return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1

    def linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        p, ty, tx, y, x1, x2 = (t[c].to_numpy() for c in ("p", "ty", "tx", "y", "x1", "x2"))
        n = len(p)
        place = np.zeros(n, dtype=np.int64)
        place[begins(t)] = 1
        line = np.cumsum(place) * high + y - (ty * tile - reach)
        left = tx * tile - reach
        a, b = np.maximum(x1 - left, 0), np.minimum(x2 - left, side - 1)
        begin, end = line * side + a, line * side + b
        root, between = np.arange(n), np.zeros(n + 1, dtype=np.int64)
        for dy, w in enumerate(wide):
            at = (line + dy) * side
            low = np.searchsorted(end, at + np.maximum(a - w, 0))
            top = np.searchsorted(begin, at + np.minimum(b + w, side - 1), side="right") - 1
            mine = np.flatnonzero(low <= top)  # reach the runs from low to top, which so are of one cluster
            root = _joined(root, mine, low[mine])
            between += np.bincount(low[mine], minlength=n + 1) - np.bincount(top[mine], minlength=n + 1)
        inner = np.flatnonzero(np.cumsum(between)[:n] > 0)
        root = _joined(root, inner, inner + 1)
        cell = p * (1 << 40) + y * (1 << 20) + x1
        own = (ty == y // tile) & (tx == x1 // tile)
        out = pa.table({"p": p, "y": y, "x1": x1, "x2": x2, "root": cell[root], "own": own, "shared": t["shared"].combine_chunks()})
        yield from out.to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                whole = pa.Table.from_batches(held)
                cuts = begins(whole)
                if len(cuts):
                    yield from linked(whole.slice(0, cuts[-1]))
                    held = whole.slice(cuts[-1]).to_batches()
                    rows -= cuts[-1]
        if rows:
            yield from linked(pa.Table.from_batches(held))

    return run


def clusters(mask: DataFrame, page: str, gap: int = 12) -> DataFrame:
    """A mask's runs with ``component``, the smallest packed number of a cell in their cluster.

    Cells are of one cluster if the mask grown by an ellipse of ``gap`` cells has a path of
    neighbours (eight each) between them; with a gap of 0 that is the mask itself. The mask is not
    grown: runs are linked by how far apart they are (``reaches``). A run goes to the tiles of its
    page that it crosses and to those whose far edges it is near, so that each link is seen in some tile; a task
    holds ``CHUNK`` runs or one tile. The least cells that a run reached in different tiles are the
    nodes and edges that are left for the components: none where a page is one tile.

    ``page``, ``y`` and ``x`` are whole numbers, and runs with a null are left out. Numbers of cells are
    ``page`` times 2^40, ``y`` times 2^20 and ``x`` together, so for ``y`` and ``x`` of 2^20 or more they may coincide.
    """
    ship_package(mask.sparkSession)
    wide = reaches(gap)
    reach = max(len(wide) - 1, *wide)
    tile = max(TILE, reach + 1)
    kinds = {c: mask.schema[c].dataType for c in (page, "y", "x1", "x2")}
    mine = materialise(merged(mask.dropna(subset=list(kinds)), page), "mask-runs")
    rows = mine.select(F.col(page).cast("long").alias("p"), *(F.col(c).cast("long").alias(c) for c in ("y", "x1", "x2")))

    def crossed(low: str, high: str) -> Column:
        """Tiles along an axis: any two cells within reach of each other have one in common."""
        first = F.greatest(F.col(low) - reach, F.least(low, F.lit(0)))
        last = F.col(high) + F.when(F.col(low) < 0, reach).otherwise(0)
        return F.sequence(F.floor(first / tile), F.floor(last / tile))

    rows = rows.withColumns({"ys": crossed("y", "y"), "xs": crossed("x1", "x2")}).withColumn("shared", F.size("ys") * F.size("xs") > 1)
    rows = rows.withColumn("ty", F.explode("ys")).withColumn("tx", F.explode("xs")).select("p", "ty", "tx", "y", "x1", "x2", "shared")
    rows = spread(rows, "p", "ty", "tx").sortWithinPartitions("p", "ty", "tx", "y", "x1")
    schema = "p long, y long, x1 long, x2 long, root long, own boolean, shared boolean"
    placed = materialise(rows.mapInArrow(_linker(gap, tile, CHUNK), schema), "mask-placed")
    own = placed.where("own").withColumn("component", F.col("root"))
    several = placed.where("shared").groupBy("p", "y", "x1").agg(F.collect_set("root").alias("roots")).where(F.size("roots") > 1)
    edges = several.select(F.array_min("roots").alias("src"), F.explode("roots").alias("dst")).where("src <> dst")
    edges = materialise(edges, "mask-edges")
    if not edges.isEmpty():
        found = connected_components(edges).select(F.col("node").alias("root"), F.col("component").alias("__least"))
        own = own.hint("merge").join(found, "root", "left").withColumn("component", F.coalesce("__least", "root"))
    given = (F.col("p" if c == page else c).cast(kind).alias(c) for c, kind in kinds.items())
    return own.select(*given, "component")
