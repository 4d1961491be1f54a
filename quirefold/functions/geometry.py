"""Column functions on regions and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    """G1: four corners clockwise from the top left, negative sizes turned round."""
    x1, x2 = F.least(x, x + w), F.greatest(x, x + w)
    y1, y2 = F.least(y, y + h), F.greatest(y, y + h)
    return F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))))


def bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )


def polygon_area(points: Column) -> Column:
    """G1: shoelace area, 0 for fewer than three points."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    total = F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(total) / 2)


def usable(points: Column) -> Column:
    """Three points or more, both sides 2 or more, area 24 or more."""
    b = bbox(points)
    return (F.size(points) >= 3) & (b["x2"] - b["x1"] >= 2) & (b["y2"] - b["y1"] >= 2) & (polygon_area(points) >= 24)


def unletterbox(v: Column, pad: Column, gain: Column, size: Column) -> Column:
    """A coordinate of the letterboxed page on the page: less the rounded pad, by the gain, clipped."""
    return F.least(F.greatest((v - F.bround(pad - F.lit(0.1), 0)) / gain, F.lit(0.0)), size.cast("double"))


def pad_amount(w: Column, h: Column, fraction: float, low: float, high: float) -> Column:
    """Pad in proportion to the short side, within bounds, rounded half to even."""
    return F.bround(F.greatest(F.least(fraction * F.least(w, h), F.lit(float(high))), F.lit(float(low))), 0)


def type_area(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Box clipped to the page and drawn in by max(5, 12 %) and max(4, 10 %), 1 px at least."""
    cx1, cy1 = F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0))
    cx2, cy2 = F.least(x2, width), F.least(y2, height)
    w, h = cx2 - cx1, cy2 - cy1
    px = F.greatest(F.lit(5), F.floor(w * 0.12).cast("int"))
    py = F.greatest(F.lit(4), F.floor(h * 0.10).cast("int"))
    return F.struct(
        (cx1 + px).cast("int").alias("x"),
        (cy1 + py).cast("int").alias("y"),
        F.greatest(F.lit(1), w - 2 * px).cast("int").alias("w"),
        F.greatest(F.lit(1), h - 2 * py).cast("int").alias("h"),
    )


def place_block(area_x: Column, area_w: Column, block_w: Column, align: Column) -> Column:
    """Left edge of a block by alignment in its area."""
    return (
        F.when(align == "left", area_x)
        .when(align == "right", area_x + area_w - block_w)
        .otherwise(area_x + (area_w - block_w) / 2)
    )


def shift_inside(lo: Column, hi: Column, size: Column) -> Column:
    """Whole-pixel shift that brings [lo, hi] into [0, size]; 0 if it is wider than that."""
    shift = F.when(lo < 0, F.ceil(-lo)).when(hi > size, -F.ceil(hi - size)).otherwise(F.lit(0))
    return F.when(hi - lo > size, F.lit(0)).otherwise(shift).cast("int")


def overlap(a: dict[str, Column], b: dict[str, Column], margin: float = 0.0) -> Column:
    """Whether two rectangles, padded by a margin, overlap with positive area."""
    return (
        (a["x1"] - margin < b["x2"] + margin)
        & (b["x1"] - margin < a["x2"] + margin)
        & (a["y1"] - margin < b["y2"] + margin)
        & (b["y1"] - margin < a["y2"] + margin)
    )


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union, 0 where the union has no area."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = w * h
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
