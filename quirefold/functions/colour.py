"""Column functions on colours and pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A hint of a colour so near the plate's is dropped; above this brightness a plate takes black text.
NEAR_PLATE, BRIGHT = 40, 127


def parse_colour(col: Column, default: str = "#000000ff") -> Column:
    """``#rgb``, ``#rrggbb`` or ``#rrggbbaa`` as struct(r, g, b, a); else the default."""
    x = F.lower(F.trim(col))
    full = (
        F.when(x.rlike("^#[0-9a-f]{3}$"), F.concat(F.regexp_replace(x, "([0-9a-f])", "$1$1"), F.lit("ff")))
        .when(x.rlike("^#[0-9a-f]{6}$"), F.concat(x, F.lit("ff")))
        .when(x.rlike("^#[0-9a-f]{8}$"), x)
        .otherwise(F.lit(default))
    )
    return F.struct(*(F.conv(F.substring(full, i, 2), 16, 10).cast("int").alias(n) for i, n in ((2, "r"), (4, "g"), (6, "b"), (8, "a"))))


def brightness(r: Column, g: Column, b: Column) -> Column:
    return (299 * r + 587 * g + 114 * b) / 1000


def contrast(r: Column, g: Column, b: Column) -> Column:
    """Black on bright plates, white on others."""
    return F.when(brightness(r, g, b) > BRIGHT, "#000000").otherwise("#ffffff")


def resolve_colour(picked: Column, measured: Column, plate: Column) -> Column:
    """User's pick, else the measured colour unless it is transparent or near the
    plate, else the contrast to the plate. All are structs of r, g, b, a."""

    def hexed(c: Column) -> Column:
        return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(c[k]), 2, "0") for k in "rgb")))

    gap = F.greatest(*(F.abs(measured[k] - plate[k]) for k in "rgb"))
    usable = measured.isNotNull() & (measured["a"] > 0) & (gap > NEAR_PLATE)
    return F.coalesce(F.when(picked.isNotNull(), hexed(picked)), F.when(usable, hexed(measured)), contrast(plate["r"], plate["g"], plate["b"]))


def auto_outline(size: Column) -> Column:
    """Outline width for a text size: 9 % of it, rounded half to even, 1 to 32."""
    return F.least(F.greatest(F.bround(size * 0.09, 0), F.lit(1.0)), F.lit(32.0)).cast("int")


def binarise(r: Column, g: Column, b: Column, limit: int = 160) -> Column:
    """255 above the limit of brightness, else 0."""
    return F.when(brightness(r, g, b) > limit, 255).otherwise(0)
