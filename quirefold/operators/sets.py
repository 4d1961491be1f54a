"""Set operations on cells and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_cells(*masks: DataFrame) -> DataFrame:
    """Cells in any mask, once."""
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()


def own_cells(own: DataFrame, detected: DataFrame, keys: list[str], whole: Column | None = None) -> DataFrame:
    """Own cells that were detected; a page without detection has none. Rows for which
    ``whole`` holds are taken as they are."""
    if whole is None:
        return own.join(detected.select(*keys).distinct().hint("merge"), keys, "left_semi")
    rest = own.where(~whole).join(detected.select(*keys).distinct().hint("merge"), keys, "left_semi")
    return own.where(whole).unionByName(rest)


def touching(parts: DataFrame, core: DataFrame, key: str) -> DataFrame:
    """Parts of whose component a cell is in the core."""
    return parts.join(core.select(key).distinct().hint("merge"), key, "left_semi")


def name_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """U4: names in one of two sets only, with the ``side`` they are on."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    left = x.join(y.hint("merge"), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(y.join(x.hint("merge"), key, "left_anti").withColumn("side", F.lit("right")))
