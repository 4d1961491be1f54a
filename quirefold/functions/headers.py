"""Sizes of images from their header bytes, as column expressions over binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of an AVIF file in which its image properties are looked for.
AVIF_HEAD = 65_536
#: Segments of a JPEG file that may come before its frame.
JPEG_SEGMENTS = 512
#: JPEG markers of a frame's start, and those without a length.
_FRAMES = [m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]
_BARE = [0x01, *range(0xD0, 0xD8)]


def _hex(content: Column, at: Column | int, n: int) -> Column:
    """``n`` bytes as hex, ``at`` counted from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.hex(F.substring(content, at + 1, F.lit(n)))


def _big(content: Column, at: Column | int, n: int) -> Column:
    return F.conv(F.nullif(_hex(content, at, n), F.lit("")), 16, 10).cast("long")


def _little(content: Column, at: int, n: int) -> Column:
    out = _big(content, at, 1)
    for i in range(1, n):
        out = out + _big(content, at + i, 1) * (1 << 8 * i)
    return out


def _signed(value: Column) -> Column:
    return F.abs(F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value))


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def _jpeg(content: Column) -> Column:
    """Segment by segment up to the frame; entropy-coded data ends the search."""
    blank = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))

    def end(width: Column, height: Column) -> Column:
        return F.struct(F.lit(None).cast("long").alias("at"), width.alias("width"), height.alias("height"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        mark, none = _big(content, at + 1, 1), F.lit(None).cast("long")
        to = lambda place: F.struct(place.cast("long").alias("at"), none.alias("width"), none.alias("height"))
        return (
            F.when(at.isNull(), state)
            .when(F.coalesce(_hex(content, at, 1), F.lit("")) != "FF", end(none, none))
            .when(mark == 0xFF, to(at + 1))
            .when(mark.isin(_BARE), to(at + 2))
            .when(mark.isin(_FRAMES), end(_big(content, at + 7, 2), _big(content, at + 5, 2)))
            .when(mark == 0xDA, end(none, none))
            .otherwise(to(at + 2 + _big(content, at + 2, 2)))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), blank, step, lambda s: _size(s["width"], s["height"]))


def _webp(content: Column) -> Column:
    kind = _hex(content, 12, 4)
    bits = _little(content, 21, 4)
    low = lambda v: v.bitwiseAND(F.lit(0x3FFF).cast("long"))
    return (
        F.when(kind == "56503858", _size(_little(content, 24, 3) + 1, _little(content, 27, 3) + 1))  # VP8X
        .when((kind == "5650384C") & (_hex(content, 20, 1) == "2F"), _size(low(bits) + 1, low(F.shiftright(bits, 14)) + 1))  # VP8L
        .when((kind == "56503820") & (_hex(content, 23, 3) == "9D012A"), _size(low(_little(content, 26, 2)), low(_little(content, 28, 2))))  # VP8
    )


def _avif(content: Column) -> Column:
    """The largest spatial extent: smaller ones are of thumbnails and tiles."""
    found = F.regexp_extract_all(_hex(content, 0, AVIF_HEAD), F.lit("69737065[0-9A-F]{8}([0-9A-F]{16})"), F.lit(1))
    side = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    sized = F.transform(found, lambda x: F.struct((side(x, 1) * side(x, 9)).alias("area"), side(x, 1).alias("width"), side(x, 9).alias("height")))
    best = F.array_max(sized)
    return _size(best["width"], best["height"])


def image_size(content: Column) -> Column:
    """struct(width, height) of a PNG, JPEG, WebP, BMP, GIF or AVIF file from its first bytes.

    What a file is goes by its content, not its name. Unknown, empty, null and cut-off
    content is 0 by 0.
    """
    four = _hex(content, 0, 4)
    brands = F.substring(_hex(content, 8, 56), 1, 112)
    old_bmp = _little(content, 14, 4) == 12
    found = (
        F.when(_hex(content, 0, 8) == "89504E470D0A1A0A", _size(_big(content, 16, 4), _big(content, 20, 4)))
        .when(F.substring(four, 1, 6) == "FFD8FF", _jpeg(content))
        .when((four == "52494646") & (_hex(content, 8, 4) == "57454250"), _webp(content))
        .when((F.substring(four, 1, 4) == "424D") & old_bmp, _size(_little(content, 18, 2), _little(content, 20, 2)))
        .when(F.substring(four, 1, 4) == "424D", _size(_signed(_little(content, 18, 4)), _signed(_little(content, 22, 4))))
        .when(four == "47494638", _size(_little(content, 6, 2), _little(content, 8, 2)))
        .when((_hex(content, 4, 4) == "66747970") & brands.rlike("^(.{8})*(61766966|61766973)"), _avif(content))
    )
    good = F.coalesce((found["width"] > 0) & (found["height"] > 0), F.lit(False))
    return F.when(good, found).otherwise(_size(F.lit(0), F.lit(0)))
