"""Context crops of clusters, their holes counted from prefix sums over blocks of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.plans.session import materialise

#: Cells on a side of a block; a row of one fits in the bits of a long.
BLOCK = 32
#: Margins tried, one larger than the other by GROW.
TRIES, GROW = 4, 1.6
#: Bounds of the first margin, the known share that is enough, and the margin that is.
LEAST, MOST, KNOWN, WIDEST = 28, 140, 0.45, 320


def _blocks(cells: DataFrame, page: str) -> DataFrame:
    """``page, by, bx, rows, n``: of each block that has cells its rows as bits, and their number."""
    placed = cells.select(page, *(F.floor(F.col(c) / BLOCK).cast("int").alias(f"b{c}") for c in "yx"), *((F.col(c) % BLOCK).cast("int").alias(f"l{c}") for c in "yx"))
    rows = placed.groupBy(page, "by", "bx", "ly").agg(F.bit_or(F.expr("shiftleft(1L, lx)")).alias("bits"))
    return rows.groupBy(page, "by", "bx").agg(F.collect_list(F.struct("ly", "bits")).alias("rows"), F.sum(F.bit_count("bits")).alias("n"))


def _prefix_sums(blocks: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """``page, by, bx, before``: cells in blocks of smaller ``by`` and smaller ``bx``, for every corner of the page's grid."""
    last = lambda size: F.ceil(F.greatest(F.col(size), F.lit(1)) / BLOCK).cast("int")
    grid = pages.select(page, F.explode(F.sequence(F.lit(0), last("height"))).alias("by"), "width")
    grid = grid.select(page, "by", F.explode(F.sequence(F.lit(0), last("width"))).alias("bx"))
    grid = grid.hint("merge").join(blocks.select(page, "by", "bx", "n"), [page, "by", "bx"], "left")
    along = Window.partitionBy(page, "by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(page, "bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("row", F.coalesce(F.sum("n").over(along), F.lit(0)))
    return grid.select(page, "by", "bx", F.coalesce(F.sum("row").over(down), F.lit(0)).alias("before"))


def holes_in(rects: DataFrame, cells: DataFrame, pages: DataFrame, page: str, key: list[str]) -> DataFrame:
    """``key, holes``: distinct cells in each rectangle ``left, top, right, bottom`` (ends exclusive, within the page).

    Blocks that lie within a rectangle are counted by four look-ups in the page's prefix sums;
    of those on its rim the rows are masked and their bits counted. A cell is one bit of one
    row, and a rectangle meets as many rows as its rim has blocks, however many holes there are.
    """
    blocks = materialise(_blocks(cells, page), "holes-blocks")
    sums = materialise(_prefix_sums(blocks, pages, page), "holes-sums")
    up = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    low = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    r = rects.select(page, *key, "left", "top", "right", "bottom").withColumns({"y0": up("top"), "y1": low("bottom"), "x0": up("left"), "x1": low("right")})
    whole = (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))
    corner = lambda y, x, sign: F.struct(F.col(y).alias("by"), F.col(x).alias("bx"), F.lit(sign).alias("sign"))
    corners = F.array(corner("y1", "x1", 1), corner("y0", "x1", -1), corner("y1", "x0", -1), corner("y0", "x0", 1))
    asked = r.where(whole).select(page, *key, F.explode(corners).alias("c")).select(page, *key, "c.*")
    inner = asked.hint("merge").join(sums, [page, "by", "bx"]).select(*key, (F.col("before") * F.col("sign")).alias("n"))

    r = r.withColumn("by", F.explode(F.sequence(low("top"), F.floor((F.col("bottom") - 1) / BLOCK).cast("int"))))
    first, last = low("left"), F.floor((F.col("right") - 1) / BLOCK).cast("int")
    crossing = whole & (F.col("by") >= F.col("y0")) & (F.col("by") < F.col("y1"))
    every = F.sequence(first, last)
    rim = F.when(crossing, F.filter(every, lambda x: (x < F.col("x0")) | (x >= F.col("x1")))).otherwise(every)
    r = r.withColumn("bx", F.explode(rim)).hint("merge").join(blocks.select(page, "by", "bx", "rows"), [page, "by", "bx"])
    at = F.greatest(F.col("left") - F.col("bx") * BLOCK, F.lit(0)).cast("int")
    to = F.least(F.col("right") - F.col("bx") * BLOCK, F.lit(BLOCK)).cast("int")
    r = r.withColumns({"at": at, "to": to})
    r = r.withColumn("mask", F.expr("shiftleft(1L, to) - shiftleft(1L, at)"))

    def inside(row: Column) -> Column:
        y = F.col("by") * BLOCK + row["ly"]
        return F.when((y >= F.col("top")) & (y < F.col("bottom")), F.bit_count(row["bits"].bitwiseAND(F.col("mask")))).otherwise(F.lit(0))

    outer = r.select(*key, F.aggregate("rows", F.lit(0).cast("long"), lambda n, row: n + inside(row)).alias("n"))
    return inner.unionByName(outer).groupBy(*key).agg(F.sum("n").alias("holes"))


def cluster_crops(clusters: DataFrame, holes: DataFrame, pages: DataFrame, page: str, box: str) -> DataFrame:
    """The crop around each cluster (``x1, y1, x2, y2``, ends exclusive) that shows enough that is known.

    The first margin is 0.6 of the longer side, 28 to 140, cut to a whole number; a crop is
    clipped at its page (``width, height``). While less than 0.45 of it is known (no cell of
    ``holes``: ``y, x``) and the margin is under 320, the margin grows by 1.6, cut again, four
    crops in all. ``rank`` numbers a page's clusters, largest first (``area`` where there is such a
    column, else that of the box). Clusters of unknown pages are left out; a cell given twice counts once.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    margin = F.floor(F.least(F.greatest(0.6 * side, F.lit(float(LEAST))), F.lit(float(MOST)))).cast("int")
    margins = [F.struct(F.lit(0).alias("k"), margin.alias("margin"))]
    for k in range(1, TRIES):
        margin = F.floor(margin * GROW).cast("int")
        margins.append(F.struct(F.lit(k).alias("k"), margin.alias("margin")))
    named = clusters.hint("merge").join(pages.select(page, "width", "height"), page)
    tries = named.select("*", F.explode(F.array(*margins)).alias("m")).select("*", "m.*").drop("m")
    m = F.col("margin")
    tries = tries.withColumns({
        "left": F.greatest(F.lit(0), F.col("x1") - m), "top": F.greatest(F.lit(0), F.col("y1") - m),
        "right": F.least(F.col("width"), F.col("x2") + m), "bottom": F.least(F.col("height"), F.col("y2") + m),
    })
    tries = materialise(tries, "crops-tries")
    real = (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top"))
    found = holes_in(tries.where(real), holes, pages, page, [page, box, "k"])
    found = tries.hint("merge").join(found, [page, box, "k"], "left")
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    found = found.withColumn("share", F.when(real, 1 - F.coalesce("holes", F.lit(0)) / area).otherwise(F.lit(0.0)))
    good = (F.col("share") >= KNOWN) | (m >= WIDEST) | (F.col("k") == TRIES - 1)
    best = found.where(good).groupBy(page, box).agg(F.min_by(F.struct(*found.columns), "k").alias("b")).select("b.*")
    size = F.col("area") if "area" in clusters.columns else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc(size), box))
    return best.withColumn("rank", rank).drop("k", "holes", "width", "height")
