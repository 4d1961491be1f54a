"""Depth inside strokes, and the colours of lettering: paper, ink and outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.aggregate import LEAST_INK, LEAST_SHARE, MOST_SHARE, SEPARABLE, modal_colour, otsu
from quirefold.plans.session import materialise

#: Pixels that make a zone worth preferring over the whole region.
LEAST_SAMPLE = 64
#: Distance from the paper, and from the line of mixtures of ink and paper, that is none of the paper's own.
PLATE_FLOOR = MIX_TOLERANCE = 18.0
#: Half-width below which a stroke cannot hold an outline of its own.
LEAST_RADIUS = 2.0
#: Core pixels below which the ink is taken from the whole stroke.
LEAST_CORE = 8
#: Inked colours of a region up to which its pixels are told by the list of them, not by their distance once more.
MOST_LISTED = 256
#: Linear light of each whole sRGB value, so that pixels raise nothing to a power.
_LINEAR = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in range(256)]


def depth(cells: DataFrame, by: str, bounds: DataFrame) -> DataFrame:
    """Each of ``cells`` (``by, x, y``) with ``depth``, its distance to the nearest place that has none.

    ``bounds`` has ``by, x0, x1, y0, y1``, the places that exist; what lies beyond is neither
    near nor far. The exact Euclidean distance, in two separable passes: along its row a
    cell's distance to the ends of its run, then over the rows of its column, within its run
    there, the least of squared row distance and squared offset. A cell looks no further than
    the nearer of its own two distances. ``depth`` is null where no other place exists.

    A run is a row while its cells are measured, so nothing is joined and ``cells`` that are
    partitioned by ``by`` are not shuffled. Cells at one place and other columns stay.
    """
    other = [c for c in cells.columns if c not in (by, "x", "y")]
    far = F.lit(None).cast("long")

    def runs(rows: DataFrame, this: str, line: str, *held: Column) -> DataFrame:
        run = F.col(this) - F.dense_rank().over(Window.partitionBy(by, line).orderBy(this))
        return rows.withColumn("__run", run).groupBy(by, line, "__run").agg(F.min(this).alias("first"), F.max(this).alias("last"), *held)

    def ends(at: Column, low: str, high: str) -> Column:
        before = F.when(F.col("first") > F.col(low), at - F.col("first") + 1).otherwise(far)
        return F.least(before, F.when(F.col("last") < F.col(high), F.col("last") - at + 1).otherwise(far))

    rows = runs(cells, "x", "y", F.collect_list(F.struct("x", *other)).alias("__cells"))
    rows = rows.join(bounds.select(by, "x0", "x1", "y0", "y1").hint("shuffle_hash"), by)
    rows = rows.select(by, "y", "y0", "y1", F.transform("__cells", lambda c: F.struct(c.alias("cell"), ends(c["x"], "x0", "x1").alias("h"))).alias("__cells"))
    rows = rows.select(by, "y", "y0", "y1", F.explode("__cells").alias("c")).select(by, "y", "y0", "y1", "c.cell.*", "c.h")
    across = F.sort_array(F.collect_set(F.struct("y", "h")))
    columns = runs(rows, "y", "x", F.min("y0").alias("y0"), F.max("y1").alias("y1"), across.alias("__across"), F.collect_list(F.struct("y", "h", *other)).alias("__cells"))
    kept = columns.select(by, "x", "first", "last", "y0", "y1", F.transform("__across", lambda a: a["h"]).alias("__across"), F.inline("__cells"))
    kept = kept.withColumn("v", ends(F.col("y"), "y0", "y1"))
    reach = F.least("h", "v", F.greatest(F.col("last") - F.col("y"), F.col("y") - F.col("first")) + 1) - 1
    kept = kept.withColumn("__low", F.greatest(F.col("y") - reach, F.col("first"))).withColumn("__high", F.least(F.col("y") + reach, F.col("last")))
    seen = F.slice("__across", (F.col("__low") - F.col("first") + 1).cast("int"), (F.col("__high") - F.col("__low") + 1).cast("int"))
    step = lambda i: F.col("__low") + i - F.col("y")
    met = F.array_min(F.transform(seen, lambda h, i: step(i) * step(i) + h * h))
    return kept.select(by, "x", "y", *other, F.sqrt(F.least(F.col("v") * F.col("v"), met).cast("double")).alias("depth"))


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of sRGB 0..255 (D65), each 0 to 255 and whole: lightness scaled, a and b moved by 128."""
    known = F.split(F.lit(",".join(map(repr, _LINEAR))), ",").cast("array<double>")

    def linear(c: Column) -> Column:
        part = c / 255.0
        other = F.when(part <= 0.04045, part / 12.92).otherwise(F.pow((part + 0.055) / 1.055, F.lit(2.4)))
        return F.when((c == F.floor(c)) & c.between(0, 255), F.get(known, c.cast("int"))).otherwise(other)

    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * 24389 / 27 + 16) / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = f((0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047)
    y = f(0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb)
    z = f((0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883)
    whole = lambda c: F.round(F.round(c, 6))  # noqa: E731  so that halves do not hang on the last bit
    return F.struct(
        whole((116 * y - 16) * 2.55).alias("l"), whole(500 * (x - y) + 128).alias("a"), whole(200 * (y - z) + 128).alias("b")
    )


def _with_lab(rows: DataFrame, *colours: str) -> DataFrame:
    """``rows`` (one a region) with ``<colour>_lab`` of struct columns, written out so that no expression nests them."""
    found = {f"{c}_lab": lab(F.col(f"{c}.r"), F.col(f"{c}.g"), F.col(f"{c}.b")) for c in colours}
    return materialise(rows.withColumns(found), "colours-lab")


def _apart(p: Column, q: Column) -> Column:
    square = lambda k: (p[k] - q[k]) * (p[k] - q[k])  # noqa: E731  F.pow takes many times as long
    return F.sqrt(square("l") + square("a") + square("b"))


def _off_segment(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the segment between two others: how far a colour is from any mixture of two."""
    dot = lambda u, v: u["l"] * v["l"] + u["a"] * v["a"] + u["b"] * v["b"]
    minus = lambda u, v: F.struct(*((u[k] - v[k]).alias(k) for k in "lab"))

    def along(x: Column) -> Column:
        """With span and way from ``a`` bound to one name."""
        length = dot(x["span"], x["span"])
        t = F.when(length < 1e-6, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x["way"], x["span"]) / length)))
        return _apart(x["way"], F.struct(*((t * x["span"][k]).alias(k) for k in "lab")))

    return F.get(F.transform(F.array(F.struct(minus(b, a).alias("span"), minus(p, a).alias("way"))), along), F.lit(0))


def _median_colour(px: DataFrame, by: str, n: str) -> DataFrame:
    mid = [F.bround(F.expr(f"percentile({c}, 0.5, {n})"), 0).cast("int").alias(c) for c in "rgb"]
    return px.groupBy(by).agg(F.struct(*mid).alias("colour"), F.sum(n).alias("n"))


def region_colours(px: DataFrame, by: str, zone: str = "zone") -> DataFrame:
    """A4: ``plate, ink, rim`` of each region from its pixels ``by, x, y, r, g, b`` and their ``zone``.

    ``zone`` is ``zone`` where a detector found lettering, ``ring`` just outside, else ``rest``.
    A zone of under 64 pixels is none. The plate is the modal colour of the ring, of all
    that is not the zone, or of the region: the first with 64 pixels, the last without a zone.
    Pixels of the zone (without one, of the region) are split by their distance from the plate;
    the inked ones lie beyond the threshold and 18. Unless the split is well apart, 40 pixels or
    more are inked and their share is plausible, ink and rim are null.

    Ink is the median of the stroke's core: depths of 0.6 of the 90th percentile and 1 or more
    (of the whole stroke if the core has under 8 pixels). Where that percentile is 2 or more and
    40 pixels lie at depth 1, their modal colour is the rim, if it is no mixture of ink and plate.

    Regions are told apart by ``by`` alone; a null zone counts as rest; a region without pixels
    has no row. Pixels repeated at one place count as often in colours and once in depth.

    Colours are counted first and all that does not ask where a pixel is goes by the counts;
    pixels are read once more for the depths of the inked ones. ``px`` that is partitioned by
    ``by`` is shuffled in neither pass.
    """
    one = px.select(by, "x", "y", "r", "g", "b", F.coalesce(F.col(zone), F.lit("rest")).alias("__zone"))
    hist = one.groupBy(by, "r", "g", "b").agg(
        F.count_if(F.col("__zone") == "zone").alias("in_zone"), F.count_if(F.col("__zone") == "ring").alias("in_ring"), F.count("*").alias("all"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    hist = materialise(hist, "colours-hist")
    sizes = hist.groupBy(by).agg(
        F.sum("in_zone").alias("zones"), F.sum("in_ring").alias("rings"), F.sum(F.col("all") - F.col("in_zone")).alias("others"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
    )
    zoned = F.col("zones") >= LEAST_SAMPLE
    source = F.when(zoned & (F.col("rings") >= LEAST_SAMPLE), "ring").when(zoned & (F.col("others") >= LEAST_SAMPLE), "outside").otherwise("all")
    sizes = materialise(sizes.withColumns({"__zoned": zoned, "__source": source}), "colours-sizes")
    rows = hist.drop("x0", "x1", "y0", "y1").join(sizes.select(by, "__zoned", "__source").hint("merge"), by)
    seen = F.when(F.col("__source") == "ring", F.col("in_ring")).when(F.col("__source") == "outside", F.col("all") - F.col("in_zone")).otherwise(F.col("all"))
    plate = modal_colour(rows.withColumn("__n", seen).where("__n > 0"), by, "__n")
    plate = _with_lab(plate.select(by, F.struct("r", "g", "b").alias("plate")), "plate")

    sample = rows.withColumn("__n", F.when(F.col("__zoned"), F.col("in_zone")).otherwise(F.col("all"))).where("__n > 0")
    away = F.round(_apart(lab(F.col("r"), F.col("g"), F.col("b")), F.col("plate_lab")), 6)
    sample = sample.join(plate.hint("merge"), by).select(by, "r", "g", "b", "__n", "__zoned", "plate_lab", away.alias("__away"))
    sample = materialise(sample, "colours-sample")
    split = otsu(sample.withColumn("__away", F.least("__away", F.lit(255.0))), by, "__away", "__n")
    split = split.where((F.col("separability") >= SEPARABLE) & (F.col("n") >= LEAST_INK))
    cut = F.greatest(F.lit(PLATE_FLOOR), F.col("threshold").cast("double"))
    inked = materialise(sample.join(split.select(by, cut.alias("__cut"), "n").hint("merge"), by).where("__away > __cut"), "colours-inked")
    packed = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    same = [F.first(c).alias(c) for c in ("__zoned", "plate_lab", "__cut")]
    enough = inked.groupBy(by).agg(F.sum("__n").alias("ink"), F.max("n").alias("n"), *same, F.collect_list(packed).alias("listed"))
    enough = enough.where((F.col("ink") >= LEAST_INK) & (F.col("ink") / F.col("n")).between(LEAST_SHARE, MOST_SHARE))
    cuts = enough.select(by, "__zoned", "plate_lab", "__cut", F.when(F.size("listed") <= MOST_LISTED, F.col("listed")).alias("listed"))
    cuts = materialise(cuts, "colours-cuts")
    whole = _median_colour(inked.join(cuts.hint("merge"), by, "left_semi"), by, "__n").select(by, F.col("colour").alias("whole"))

    body = one.join(cuts.hint("shuffle_hash"), by).where(~F.col("__zoned") | (F.col("__zone") == "zone"))
    is_ink = F.when(F.col("listed").isNotNull(), F.array_contains("listed", packed)).otherwise(away > F.col("__cut"))
    body = body.where(is_ink).select(by, "x", "y", "r", "g", "b")
    deep = depth(body, by, sizes).groupBy(by, "r", "g", "b", "depth").agg(F.count("*").alias("__n"))
    deep = materialise(deep, "colours-depth")
    radius = deep.groupBy(by).agg(F.round(F.expr("percentile(depth, 0.9, __n)"), 9).alias("radius"))
    deep = deep.join(radius.hint("merge"), by)
    core = deep.where(F.round(F.col("depth"), 9) >= F.greatest(F.lit(1.0), F.round(0.6 * F.col("radius"), 9)))
    core = _median_colour(core, by, "__n").where(F.col("n") >= LEAST_CORE).select(by, F.col("colour").alias("core"))
    edge = deep.where((F.col("depth") <= 1.0) & (F.col("radius") >= LEAST_RADIUS))
    sized = edge.groupBy(by).agg(F.sum("__n").alias("at_edge"))
    edge = modal_colour(edge, by, "__n")
    edge = edge.join(sized.where(F.col("at_edge") >= LEAST_INK).hint("merge"), by).select(by, F.struct("r", "g", "b").alias("edge"))
    found = plate.join(whole.hint("merge"), by, "left").join(core.hint("merge"), by, "left").join(edge.hint("merge"), by, "left")
    found = _with_lab(found.select(by, "plate", "plate_lab", F.coalesce("core", "whole").alias("ink"), "edge"), "ink", "edge")
    third = _off_segment(F.col("edge_lab"), F.col("plate_lab"), F.col("ink_lab"))
    return found.select(by, "plate", "ink", F.when(F.round(third, 6) > MIX_TOLERANCE, F.col("edge")).alias("rim"))
