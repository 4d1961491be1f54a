"""Text layout as column functions: greedy wrap, block size, largest size that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (6, 72)


def _word_pieces(word: Column, width: Column, room: Column) -> Column:
    """A word that is too wide, cut after its single inner hyphens; else as it is."""
    cut = F.split(F.regexp_replace(word, r"(?<=[^-])-(?=[^-])", "-\u0001"), "\u0001")
    return F.when(width > room, cut).otherwise(F.array(word))


def wrap(text: Column, width: Column, advance: float | Column = 1.0) -> Column:
    """L1: lines of a text wrapped greedily at ``width``, less 2 and 1 at least.

    Paragraphs end at line ends (CR, LF or both), words at white space; a blank
    paragraph is one empty line. ``advance`` is a character's width, or a map of
    characters to widths (others count 1). A word wider than a line breaks only after its
    own single inner hyphens, else it stays whole.
    """
    room = F.greatest(width - 2, F.lit(1.0))

    def measure(s: Column) -> Column:
        if isinstance(advance, Column):
            return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0.0), lambda t, c: t + F.coalesce(F.try_element_at(advance, c), F.lit(1.0)))
        return F.length(s) * float(advance)

    space = measure(F.lit(" "))

    def one(paragraph: Column) -> Column:
        words = F.filter(F.split(F.trim(F.regexp_replace(paragraph, r"(?U)\s+", " ")), " "), lambda w: w != "")
        pieces = F.flatten(
            F.transform(words, lambda w: F.transform(_word_pieces(w, measure(w), room), lambda p, i: F.struct(p.alias("t"), (i == 0).alias("gap"))))
        )

        def step(state: Column, piece: Column) -> Column:
            w = measure(piece["t"])
            empty = state["line"] == ""
            lead = F.when(piece["gap"] & ~empty, space).otherwise(F.lit(0.0))
            joined = F.concat(state["line"], F.when(piece["gap"] & ~empty, " ").otherwise(""), piece["t"])
            fits = empty | (state["w"] + lead + w <= room)
            return F.struct(
                F.when(fits, state["lines"]).otherwise(F.concat(state["lines"], F.array(state["line"]))).alias("lines"),
                F.when(fits, joined).otherwise(piece["t"]).alias("line"),
                F.when(fits, state["w"] + lead + w).otherwise(w).alias("w"),
            )

        start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("w"))
        return F.aggregate(pieces, start, step, lambda s: F.concat(s["lines"], F.array(s["line"])))

    paragraphs = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    return F.flatten(F.transform(paragraphs, one))


def block_size(lines: Column, size: Column, advance: float = 0.5, factor: float = 1.0) -> Column:
    """L2: struct(width, height) of lines set at ``size``.

    A character is ``advance`` sizes wide; gaps between words are ``factor`` spaces.
    Lines are one size high with max(1, floor(0.14 size + 0.5)) between them.
    """
    space = advance * size
    width = F.transform(lines, lambda s: F.length(s) * space + F.greatest(F.size(F.split(s, " ")) - 1, F.lit(0)) * (factor - 1) * space)
    gap = F.greatest(F.lit(1.0), F.floor(0.14 * size + 0.5).cast("double"))
    n = F.size(lines)
    return F.struct(F.coalesce(F.array_max(width), F.lit(0.0)).alias("width"), ((n - 1) * (size + gap) + size).cast("double").alias("height"))


def fit_size(texts: DataFrame, key: str, text: str, width: str, height: str, advance: float = 0.5) -> DataFrame:
    """K2: per text the largest size of 6 to 72 at which it fits its box, wrapped; null if none.

    Fitting is taken to be monotone in the size, so a binary search wraps a text seven
    times at most, within its row. Where a smaller size happens to wrap worse the search
    may miss a larger one, but what it gives fits. A key has one row; nothing is shuffled.
    """
    w, h = F.col(width).cast("double"), F.col(height).cast("double")

    def fits(size: Column) -> Column:
        block = block_size(wrap(F.col(text), w / (advance * size), 1.0), size, advance)
        return F.transform(F.array(block), lambda b: (b["width"] <= w) & (b["height"] <= h))[0]

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")

        def narrowed(t: Column) -> Column:
            low = F.when(t["fits"], t["mid"] + 1).otherwise(s["low"])
            high = F.when(t["fits"], s["high"]).otherwise(t["mid"] - 1)
            return F.struct(low.alias("low"), high.alias("high"), F.when(t["fits"], t["mid"]).otherwise(s["best"]).alias("best"))

        tried = F.transform(F.array(mid), lambda m: F.struct(m.alias("mid"), F.coalesce(fits(m), F.lit(False)).alias("fits")))
        return F.when(s["low"] > s["high"], s).otherwise(F.transform(tried, narrowed)[0])

    start = F.struct(F.lit(SIZES[0]).alias("low"), F.lit(SIZES[1]).alias("high"), F.lit(None).cast("int").alias("best"))
    steps = F.sequence(F.lit(1), F.lit((SIZES[1] - SIZES[0] + 1).bit_length()))
    return texts.select(key, F.aggregate(steps, start, halve, lambda s: s["best"]).alias("size"))


def overflow_report(texts: DataFrame, key: str, page: str, text: str, width: str, height: str, advance: float = 0.5) -> DataFrame:
    """L3: per page how many texts do not fit even at the smallest size; a null box fits nothing."""
    w, size = F.col(width).cast("double"), F.lit(SIZES[0])
    block = block_size(wrap(F.col(text), w / (advance * size), 1.0), size, advance)
    rows = texts.select(page, F.transform(F.array(block), lambda b: (b["width"] <= w) & (b["height"] <= F.col(height)))[0].alias("fits"))
    return rows.groupBy(page).agg(F.count("*").alias("texts"), F.count_if(~F.coalesce("fits", F.lit(False))).alias("overflow"))
