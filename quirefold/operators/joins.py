"""Join operators: rosters, glossaries, regions, overlaps, inventories, ownership."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions import geometry as G
from quirefold.functions.text import clean_name
from quirefold.operators import masks
from quirefold.operators.graph import connected_components
from quirefold.operators.order import reading_order
from quirefold.plans.session import materialise, ship_package

SIDES = ("x1", "y1", "x2", "y2")
FIELDS = ["name_en", "name_ja", "gender", "alias_en", "alias_ja"]
#: Boxes of a page of at most so many meet each other without a grid.
FEW = 64
#: A table of at most so many code points is broadcast.
ALPHABET = 200_000


def with_speaker(entries: DataFrame, roster: DataFrame, key: str = "character_id") -> DataFrame:
    """Entries with ``speaker`` (null if unknown), ``ordinal`` ("Character n" by roster
    order) and ``label``: the first name that is not blank, else the id's first 8 letters.
    Rosters have 50 rows a destination at most and are broadcast."""
    named = roster.withColumn("n", F.row_number().over(Window.orderBy("ord")))
    names = [F.nullif(F.trim(c), F.lit("")) for c in ("name_en", "name_ja", "alias_en", "alias_ja")]
    side = named.select(
        F.col("meta_id").alias("speaker"), F.concat(F.lit("Character "), "n").alias("ordinal"),
        F.coalesce(*names, F.substring("meta_id", 1, 8)).alias("label"),
    )
    return entries.join(F.broadcast(side), F.col(key) == F.col("speaker"), "left")


def _name_finder(names: list[tuple[str, list]]):
    """A function from a text to the keys of the names in it: one pass over the text, all names at once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, (name, _) in enumerate(names):
        automaton.add_word(name, i)
    if names:
        automaton.make_automaton()

    def find(text: str | None) -> list:
        if not text or not names:
            return []
        met = {i for _, i in automaton.iter(text)}
        return list(dict.fromkeys(k for i in sorted(met) for k in names[i][1]))

    return find


def _names_in(col: Column, sent, kind: T.ArrayType) -> Column:
    @F.pandas_udf(kind)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _name_finder(sent.value)
        for batch in batches:
            yield pd.Series([find(x) for x in batch], dtype=object)

    return found(col)


def mentions(texts: DataFrame, roster: DataFrame, text: str, key: str, names: list[str], part_chars: int = 4_000_000) -> DataFrame:
    """A row for each text row and roster key one of whose names is in the text, case-sensitively.

    All names are looked for in one pass over a text by an Aho-Corasick automaton, which
    each worker builds once from a broadcast list. The list is bounded: the names' characters
    are summed first and the keys dealt by hash over as many automata as ``part_chars``
    allows, one for most glossaries and a pass over the texts for each beyond; a key's names
    stay together. Nothing is shuffled but the roster, and a text gives only its findings.

    Null and empty names and texts are in nothing; roster rows of one key (null is one) are
    one; text rows that repeat stay rows. An automaton larger than ``part_chars`` comes only
    of a hash that deals unevenly, or of one key that alone has more.
    """
    spark = texts.sparkSession
    ship_package(spark)
    listed = F.array_compact(F.array(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names)))
    keyed = roster.select(F.col(key).alias("__key"), F.explode(listed).alias("__name")).distinct()
    keyed = materialise(keyed, "mentions-names")
    size = keyed.agg(F.sum(F.length("__name"))).first()[0] or 0
    parts = max(1, -(-size // part_chars))
    kind = T.ArrayType(roster.schema[key].dataType)
    out = None
    for part in range(parts):
        mine = keyed.where(F.pmod(F.xxhash64("__key"), F.lit(parts)) == part)
        mine = mine.groupBy("__name").agg(F.array_sort(F.collect_list(F.struct("__key"))).alias("__keys"))
        held = [(r["__name"], [k["__key"] for k in r["__keys"]]) for r in mine.collect()]  # some part_chars characters
        met = texts.withColumn("__met", _names_in(F.col(text), spark.sparkContext.broadcast(held), kind))
        met = met.select(*texts.columns, F.explode("__met").alias(key))
        out = met if out is None else out.unionAll(met)
    return out


def glossary(roster: DataFrame, order: str) -> DataFrame:
    """(original, english) pairs of names, then aliases, both present; the first of an original stays."""
    pairs = F.array(
        F.struct(F.lit(0).alias("k"), F.col("name_ja").alias("original"), F.col("name_en").alias("english")),
        F.struct(F.lit(1).alias("k"), F.col("alias_ja").alias("original"), F.col("alias_en").alias("english")),
    )
    rows = roster.select(order, F.inline(pairs)).where("trim(original) <> '' AND trim(english) <> ''")
    return rows.groupBy("original").agg(F.min_by("english", F.struct(order, "k")).alias("english"), F.min(order).alias(order))


def upsert_regions(
    existing: DataFrame, incoming: DataFrame, page: str, points: str = "points", at: DataFrame | None = None, right_to_left: bool = False
) -> DataFrame:
    """Incoming regions equal to an existing one (same points in the same order) replace
    its text and keep its ``style``; others are added; fewer than three points are dropped.
    Of equal incoming regions the last ``pos`` counts.

    ``pos`` numbers a page's regions from 0: existing ones keep their order (of their ``pos``), and
    added ones, sorted among themselves in reading order (W2), come behind them or, where
    ``at`` (``page, at``) names a place, before the existing region of that place.
    """
    key = F.sha2(F.to_json(F.struct(page, points)), 256)
    new = incoming.where(F.size(points) >= 3).withColumn("__key", key)
    new = new.groupBy("__key").agg(F.max_by(F.struct(page, points, "text", "pos"), "pos").alias("n"))
    old = existing.withColumn("__key", key).withColumn("__old", F.row_number().over(Window.partitionBy(page).orderBy("pos", "__key")) - 1)
    both = old.hint("merge").join(new, "__key", "full").select(
        "__key", "__old",
        F.coalesce(F.col(page), F.col(f"n.{page}")).alias(page),
        F.coalesce(F.col(points), F.col(f"n.{points}")).alias(points),
        F.coalesce(F.col("n.text"), F.col("text")).alias("text"),
        F.col("style"),
        F.when(F.col("n.text").isNull(), "kept").when(F.col(page).isNull(), "added").otherwise("replaced").alias("status"),
    )
    both = materialise(both, "upsert-rows")
    added = both.where("status = 'added'").select(page, "__key", G.bbox(F.col(points)).alias("__b"))
    added = added.select(page, "__key", *(F.col(f"__b.{c}").cast("double").alias(c) for c in SIDES))
    nth = reading_order(added, page, "__key", right_to_left).select("__key", F.col("nth").alias("__nth"))
    counts = both.groupBy(F.col(page).alias("__page")).agg(F.count("__old").alias("__olds"), F.count_if(F.col("status") == "added").alias("__news"))
    counts = counts.withColumn("__at", F.lit(None).cast("long")) if at is None else (
        counts.hint("merge").join(at.select(F.col(page).alias("__page"), F.col("at").cast("long").alias("__at")), "__page", "left")
    )
    place = F.least(F.greatest(F.coalesce("__at", "__olds"), F.lit(0)), F.col("__olds"))
    out = both.hint("merge").join(nth, "__key", "left").join(counts.hint("merge"), F.col(page).eqNullSafe(F.col("__page")))
    moved = F.when(F.col("__old") < place, F.col("__old")).otherwise(F.col("__old") + F.col("__news"))
    pos = F.when(F.col("status") == "added", place + F.col("__nth") - 1).otherwise(moved).cast("long")
    return out.select(page, points, "text", "style", "status", pos.alias("pos"))


def _binned_pairs(boxes: DataFrame, page: str, box: str, cell: float, grow: Column | float = 0.0) -> DataFrame:
    """Pairs of boxes of a page that may be within ``grow`` of each other, each pair once, as ``a`` and ``b``.

    On a page of ``FEW`` boxes or fewer those are all its pairs, ``FEW`` / 2 a box at most; on others
    those that share a cell of a grid. The grid has levels, each with cells twice as wide as the one below; a box, padded by
    ``grow`` each side, is at the first level whose cells are as large as it is, in four
    cells at most. It also looks in its place on the levels above that its page has, so that
    two boxes meet at the level of the larger, and a box as large as the page costs four cells
    and not one for each of the smallest. A pair is taken in the cell of the larger of the
    two upper left corners, so it needs no distinct.
    """
    pad = F.lit(float(grow)) if isinstance(grow, (int, float)) else grow
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * pad
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(float(cell))) / cell))).cast("int")
    sized = boxes.withColumns({"__pad": pad, "__level": level})
    kept = [page, box, *SIDES, *(c for c in ("score", "area") if c in boxes.columns), "__pad", "__level"]
    levels = sized.groupBy(F.col(page).alias("__page")).agg(F.collect_set("__level").alias("__levels"), F.count("*").alias("__n"))
    sized = sized.select(*kept).hint("merge").join(levels, F.col(page) == F.col("__page")).drop("__page")
    sized = materialise(sized, "pairs-boxes")
    row = F.struct(
        F.col(box).alias("id"), *SIDES, *(F.col(c) for c in ("score", "area") if c in boxes.columns),
        *((F.col(lo) - F.col("__pad")).alias(f"from_{lo}") for lo in ("x1", "y1")), F.col("__level").alias("level"),
    )
    few = sized.where(F.col("__n") <= FEW)
    few = few.select(page, row.alias("a")).hint("merge").join(few.select(page, row.alias("b")), page).where("a.id < b.id")
    sized = sized.where(F.col("__n") > FEW)
    if sized.isEmpty():
        return few
    at = F.explode(F.filter("__levels", lambda x: x >= F.col("__level")))
    placed = sized.withColumn("__at", at).withColumn("__cell", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("__at")))
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - F.col("__pad")) / F.col("__cell")), F.floor((F.col(hi) + F.col("__pad")) / F.col("__cell")))
    placed = placed.withColumn("__cy", F.explode(span("y1", "y2"))).withColumn("__cx", F.explode(span("x1", "x2")))
    keys = [page, "__at", "__cy", "__cx"]
    looks = placed.select(*keys, "__cell", row.alias("a"))
    owns = placed.where("__at = __level").select(*keys, row.alias("b"))
    met = looks.hint("merge").join(owns, keys).where("a.level < b.level OR (a.level = b.level AND a.id < b.id)")
    home = (F.floor(F.greatest("a.from_x1", "b.from_x1") / F.col("__cell")) == F.col("__cx")) & (
        F.floor(F.greatest("a.from_y1", "b.from_y1") / F.col("__cell")) == F.col("__cy")
    )
    ordered = F.col("a.id") < F.col("b.id")
    low, high = F.when(ordered, F.col("a")).otherwise(F.col("b")), F.when(ordered, F.col("b")).otherwise(F.col("a"))
    return few.unionByName(met.where(home & (F.col("a.id") != F.col("b.id"))).select(page, low.alias("a"), high.alias("b")))


def _side(name: str) -> dict[str, Column]:
    return {k: F.col(f"{name}.{k}") for k in SIDES}


def overlaps(boxes: DataFrame, page: str, box: str, margin: float = 0.0, cell: int = 128) -> DataFrame:
    """Pairs of boxes of a page that overlap when each is padded by ``margin``."""
    pairs = _binned_pairs(boxes, page, box, cell, margin)
    return pairs.where(G.overlap(_side("a"), _side("b"), margin))


def _nearly_identical(near: Column, area) -> Column:
    """J5's test of the boxes ``a`` and ``b``."""
    ok = (F.least(area("a"), area("b")) > 0) & (F.least(area("a"), area("b")) >= 0.97 * F.greatest(area("a"), area("b")))
    for lo, hi in (("x1", "x2"), ("y1", "y2")):
        ok = ok & (F.abs(F.col(f"a.{lo}") - F.col(f"b.{lo}")) <= near)
        ok = ok & (F.abs((F.col(f"a.{hi}") - F.col(f"a.{lo}")) - (F.col(f"b.{hi}") - F.col(f"b.{lo}"))) <= near)
    return ok


def near_duplicates(boxes: DataFrame, page: str, box: str, cell: int = 128) -> DataFrame:
    """Pairs with areas within 97 % whose left and upper edges, widths and heights are within max(2, 2 % of the longest side).

    The area is the column ``area`` where there is one (a polygon's), else that of the box; pairs
    without area are none.
    """
    longest = F.greatest(*(F.col(f"{n}.{b}") - F.col(f"{n}.{a}") for n in "ab" for a, b in (("x1", "x2"), ("y1", "y2"))))
    near = F.greatest(F.lit(2.0), 0.02 * longest)
    whole = lambda n: (F.col(f"{n}.x2") - F.col(f"{n}.x1")) * (F.col(f"{n}.y2") - F.col(f"{n}.y1"))
    area = (lambda n: F.col(f"{n}.area")) if "area" in boxes.columns else whole
    ok = _nearly_identical(near, area)
    reach = F.greatest(F.lit(2.0), 0.02 * F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return _binned_pairs(boxes, page, box, cell, reach).where(ok)


def _beaten(edges: DataFrame, page: str) -> DataFrame | None:
    """``page, lo`` of what a greedy pass drops, from edges ``hi`` (earlier) to ``lo``: every round keeps what no
    live earlier one touches and drops what a kept one touches. None if there are no edges."""
    gone = None
    while not edges.isEmpty():
        below = edges.select(page, F.col("lo").alias("hi")).distinct()
        safe = edges.select(page, "hi").distinct().join(below.hint("merge"), [page, "hi"], "left_anti")
        dropped = materialise(edges.join(safe.hint("merge"), [page, "hi"], "left_semi").select(page, "lo").distinct(), "nms-dropped")
        gone = dropped if gone is None else gone.unionByName(dropped)
        rest = edges.join(dropped.hint("merge"), [page, "lo"], "left_anti")
        rest = rest.join(dropped.select(page, F.col("lo").alias("hi")).hint("merge"), [page, "hi"], "left_anti")
        rest = rest.join(safe.hint("merge"), [page, "hi"], "left_anti")
        edges = materialise(rest, "nms-edges")
    return gone


def accept_regions(pieces: DataFrame, sources: DataFrame, regions: DataFrame, source: str, piece: str, page: str, points: str = "points") -> DataFrame:
    """G5, second half: the pieces of cut regions that become regions of their own.

    ``pieces`` (``source, piece, rank`` and points) are taken in order of rank. Dropped are those
    that are not usable (G2), the region they were cut from (``sources``: ``page, source``, points)
    or a near-copy of it (J5), one that the page already has (``regions``: ``page, source``, points) other
    than the source, and near-copies of a piece of the same source kept before: a fixpoint of
    joins as in J6, for areas of any size and number.
    """
    cut = pieces.where(G.usable(F.col(points))).withColumns({"__b": G.bbox(F.col(points)), "area": G.polygon_area(F.col(points))})
    cut = cut.select(source, piece, "rank", F.col(points).alias("__p"), "area", *(F.col(f"__b.{c}").cast("double").alias(c) for c in SIDES))
    of = sources.select(F.col(source).alias("__s"), page, F.col(points).alias("__q"), G.bbox(F.col(points)).alias("__b"), G.polygon_area(F.col(points)).alias("__a"))
    of = of.select("__s", page, "__q", F.struct(*(F.col(f"__b.{c}").cast("double").alias(c) for c in SIDES), F.col("__a").alias("area")).alias("b"))
    met = cut.withColumn("a", F.struct(*SIDES, "area")).hint("merge").join(of, F.col(source) == F.col("__s"), "left")
    longest = F.greatest(*(F.col(f"{n}.{b}") - F.col(f"{n}.{a}") for n in "ab" for a, b in (("x1", "x2"), ("y1", "y2"))))
    alike = _nearly_identical(F.greatest(F.lit(2.0), 0.02 * longest), lambda n: F.col(f"{n}.area")) | (F.to_json("__p") == F.to_json("__q"))
    cut = met.where(~F.coalesce(alike, F.lit(False))).withColumn("__key", F.sha2(F.to_json(F.struct("__p")), 256)).drop("a", "b", "__q", "__s")
    there = regions.select(F.col(page).alias("__page"), F.col(source).alias("__other"), F.sha2(F.to_json(F.struct(F.col(points).alias("__p"))), 256).alias("__has"))
    own = F.col("__other").eqNullSafe(F.col(source))
    cut = cut.hint("merge").join(there, (F.col(page) == F.col("__page")) & (F.col("__key") == F.col("__has")) & ~own, "left_anti")
    cut = materialise(cut.select(source, piece, "rank", "area", *SIDES), "accept-pieces")
    place = cut.select(source, F.col(piece).alias("id"), "rank")
    near = near_duplicates(cut, source, piece).select(source, F.col("a.id").alias("p"), F.col("b.id").alias("q"))
    near = near.hint("merge").join(place.select(source, F.col("id").alias("p"), F.col("rank").alias("rp")), [source, "p"])
    near = near.hint("merge").join(place.select(source, F.col("id").alias("q"), F.col("rank").alias("rq")), [source, "q"])
    first = F.struct("rp", "p") < F.struct("rq", "q")
    edges = near.select(source, F.when(first, F.col("p")).otherwise(F.col("q")).alias("hi"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("lo"))
    gone = _beaten(materialise(edges, "accept-near"), source)
    return cut if gone is None else cut.join(gone.select(source, F.col("lo").alias(piece)).hint("merge"), [source, piece], "left_anti")


def suppress(
    boxes: DataFrame, page: str, box: str, conf: float = 0.25, iou: float = 0.7, before: int = 30_000, most: int = 300, cell: int = 128
) -> DataFrame:
    """Boxes left by greedy suppression, best first as ``rank``.

    Of boxes with a score above ``conf``, ``before`` a page at most, in order of score
    then id, one is kept unless a kept one before it overlaps it by more than ``iou``;
    at most ``most`` stay. As a fixpoint: every round keeps boxes that no live box of a
    higher rank overlaps, and drops those that a kept one overlaps. A round only moves
    overlapping pairs; the loop ends when none is left.
    """
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), box))
    live = boxes.where(F.col("score") > conf).withColumn("__rank", rank).where(F.col("__rank") <= before)
    live = materialise(live.select(page, box, *SIDES, "score", "__rank"), "nms-boxes")
    hit = _binned_pairs(live, page, box, cell).where(G.iou(_side("a"), _side("b")) > iou)
    first = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.id") < F.col("b.id")))
    edges = hit.select(page, F.when(first, F.col("a.id")).otherwise(F.col("b.id")).alias("hi"), F.when(first, F.col("b.id")).otherwise(F.col("a.id")).alias("lo"))
    edges = materialise(edges, "nms-edges")
    gone = _beaten(edges, page)
    kept = live if gone is None else live.join(gone.select(page, F.col("lo").alias(box)).hint("merge"), [page, box], "left_anti")
    order = F.row_number().over(Window.partitionBy(page).orderBy("__rank"))
    return kept.withColumn("rank", order).where(F.col("rank") <= most).drop("__rank")


def components(boxes: DataFrame, page: str, box: str, gap: float = 12, cell: int = 128) -> DataFrame:
    """Groups of boxes whose rectangles, padded by ``gap``, overlap: ``component`` is the
    smallest id of each. Ids are unique over pages."""
    pairs = overlaps(boxes, page, box, gap, cell)
    found = connected_components(pairs.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")))
    out = boxes.join(found.select(F.col("node").alias(box), "component").hint("merge"), box, "left")
    return out.withColumn("component", F.coalesce("component", F.col(box)))


def cell_components(cells: DataFrame, page: str) -> DataFrame:
    """8-neighbour components of cells (y, x): ``component`` is the smallest packed cell number.

    Cells given twice count once; a cell with a null has none. They are linked as runs within tiles (``masks.clusters``).
    """
    there = F.col(page).isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    found = masks.clusters(cells.where(there).select(page, "y", F.col("x").alias("x1"), F.col("x").alias("x2")), page, 0)
    out = found.select(page, "y", F.explode(F.sequence("x1", "x2")).alias("x"), "component")
    return out.unionByName(cells.where(~there).select(page, "y", "x").distinct().withColumn("component", F.lit(None).cast("long")))


def drop_specks(parts: DataFrame, page: str, box: str, least: int, cell: int = 128) -> DataFrame:
    """Components (box, ``area, radius, mean_p, max_p``) worth keeping.

    Those of ``least`` area or more stay; if a page has none, nothing does. Small ones of
    max(6, least // 8) or more stay within three stroke radii of a kept one, or with a
    mean probability of 0.6 or a greatest of 0.9.
    """
    big = parts.where(F.col("area") >= least)
    pages = big.select(page).distinct()
    small = parts.where((F.col("area") < least) & (F.col("area") >= max(6, least // 8))).join(pages.hint("merge"), page, "left_semi")
    sure = small.where((F.col("mean_p") >= 0.6) | (F.col("max_p") >= 0.9))
    return big.unionByName(sure).unionByName(_near(small.where("NOT (mean_p >= 0.6 OR max_p >= 0.9)"), big, page, box, 3 * F.col("radius"), cell))


def _near(rows: DataFrame, kept: DataFrame, page: str, box: str, reach: Column, cell: int) -> DataFrame:
    """Rows whose rectangle is within ``reach`` of a kept one's: a semi-join on shared cells."""
    rows = rows.withColumn("__r", reach)
    span = lambda lo, hi, r: F.sequence(F.floor((F.col(lo) - r) / cell), F.floor((F.col(hi) + r) / cell))
    a = rows.withColumn("__cy", F.explode(span("y1", "y2", F.col("__r")))).withColumn("__cx", F.explode(span("x1", "x2", F.col("__r"))))
    b = kept.withColumn("__cy", F.explode(span("y1", "y2", F.lit(0)))).withColumn("__cx", F.explode(span("x1", "x2", F.lit(0))))
    b = b.select(page, "__cy", "__cx", *(F.col(k).alias(f"__{k}") for k in SIDES))
    dx = F.greatest(F.lit(0), F.col("__x1") - F.col("x2"), F.col("x1") - F.col("__x2"))
    dy = F.greatest(F.lit(0), F.col("__y1") - F.col("y2"), F.col("y1") - F.col("__y2"))
    on = [a[k] == b[k] for k in (page, "__cy", "__cx")]
    close = dx * dx + dy * dy <= F.col("__r") * F.col("__r")
    hit = a.join(b.hint("merge"), [*on, close], "left_semi")
    return hit.drop("__cy", "__cx", "__r").dropDuplicates([page, box])


def drop_unsupported(parts: DataFrame, page: str, box: str, cell: int = 128) -> DataFrame:
    """Components (box, ``area, votes, thin``) that scales agree on.

    Supported are those with 200 votes or votes on a quarter of their area; thin small
    ones (``thin`` and area 400 or less) are exempt; weak ones stay only within 16 px of
    a supported one, with an area of 400 or less or 30 votes.
    """
    strong = (F.col("votes") >= 200) | (F.col("votes") >= 0.25 * F.col("area"))
    exempt = F.col("thin") & (F.col("area") <= 400)
    supported = parts.where(strong)
    weak = parts.where(~strong & ~exempt & ((F.col("area") <= 400) | (F.col("votes") >= 30)))
    return supported.unionByName(parts.where(~strong & exempt)).unionByName(_near(weak, supported, page, box, F.lit(16.0), cell))


def assign_faces(chars: DataFrame, coverage: DataFrame, order: dict[str, int], forced: dict[int, str] | None = None, primary: str = "primary") -> DataFrame:
    """The face of each character (``cp``): its forced owner if that covers it, else the
    first that does in ``order``, else the primary face's missing glyph (``missing``).

    Only distinct code points meet the coverage table; white space has none. Their faces are
    written and counted: up to ``ALPHABET`` of them (there are 1,114,112 code points at all)
    are broadcast, so that characters, of which a few are most, are not shuffled; more are merged.
    """
    rank = F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v))))
    owner = F.create_map(*(x for k, v in (forced or {-1: ""}).items() for x in (F.lit(k), F.lit(v))))
    own = F.coalesce(F.try_element_at(owner, F.col("cp")) == F.col("face"), F.lit(False))
    known = chars.select("cp").distinct().where(~F.col("cp").isin(9, 10, 11, 12, 13, 32, 0x3000))
    found = known.join(coverage.hint("merge"), "cp").groupBy("cp").agg(
        F.min_by("face", F.when(own, F.lit(-1)).otherwise(F.coalesce(F.try_element_at(rank, F.col("face")), F.lit(1 << 20)))).alias("face")
    )
    faces = known.join(found.hint("merge"), "cp", "left").select(
        "cp", F.coalesce("face", F.lit(primary)).alias("face"), F.col("face").isNull().alias("missing")
    )
    faces = materialise(faces, "faces")
    hint = "broadcast" if faces.count() <= ALPHABET else "merge"
    return chars.join(faces.hint(hint), "cp", "left")


def calibrate(glyphs: DataFrame, primary: str, fallback: str) -> DataFrame:
    """Per code point in both faces the scale primary height / fallback height, 0.5 to 3."""
    a = glyphs.where(F.col("face") == primary).select("cp", F.col("height").alias("__h"))
    b = glyphs.where(F.col("face") == fallback).select("cp", F.col("height").alias("__f"))
    return a.join(b.hint("merge"), "cp").where("__f > 0").select("cp", F.least(F.greatest(F.col("__h") / F.col("__f"), F.lit(0.5)), F.lit(3.0)).alias("scale"))


def reconcile_inventory(expected: DataFrame, actual: DataFrame, key: str, size: str, digest: str | None = None) -> DataFrame:
    """What differs: ``missing``, ``unexpected``, ``size`` or ``digest`` by name; none is a pass."""
    cols = [size] + ([digest] if digest else [])
    a = expected.select(key, F.lit(True).alias("__e"), *(F.col(c).alias(f"__e_{c}") for c in cols))
    b = actual.select(key, F.lit(True).alias("__a"), *(F.col(c).alias(f"__a_{c}") for c in cols))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected")
    status = status.when(~F.col(f"__e_{size}").eqNullSafe(F.col(f"__a_{size}")), "size")
    if digest:
        status = status.when(~F.col(f"__e_{digest}").eqNullSafe(F.col(f"__a_{digest}")), "digest")
    return a.join(b.hint("merge"), key, "full").select(key, status.alias("status")).where("status IS NOT NULL")


def match_suffixes(files: DataFrame, patterns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Files whose name ends in a pattern, each with its ``pattern``, and the patterns
    that none does. Names that begin with a dot are left out. Patterns are a short list of the caller's."""
    table = files.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    hit = files.where(~F.col(name).startswith(".")).join(F.broadcast(table), F.col(name).endswith(F.col("pattern")))
    return hit, table.join(hit.select("pattern").distinct().hint("merge"), "pattern", "left_anti")


def stale(items: DataFrame, ledger: DataFrame, key: str, document: list[str], digest: str = "digest") -> DataFrame:
    """Items whose stored fingerprint is not that of the current document; unknown ones are stale."""
    now = items.withColumn("current", F.sha2(F.to_json(F.struct(*sorted(document)), {"ignoreNullFields": "false"}), 256))
    side = ledger.select(key, F.col(digest).alias("accepted"))
    return now.join(side.hint("merge"), key, "left").where(~F.col("current").eqNullSafe(F.col("accepted")))


def repair_assignments(active: DataFrame, endpoints: DataFrame, most: int = 3) -> DataFrame:
    """Per language (``lang, ids``) the ids that exist and list the language, each
    once, in order, ``most`` at most. Languages without any have an empty list."""
    rows = active.select("lang", F.posexplode("ids").alias("pos", "id"))
    good = endpoints.select("id", F.explode("langs").alias("lang")).distinct()
    kept = rows.join(good.hint("merge"), ["lang", "id"], "left_semi")
    once = kept.groupBy("lang", "id").agg(F.min("pos").alias("pos"))
    first = once.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy("pos"))).where(F.col("__n") <= most)
    lists = first.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    return active.select("lang").join(lists.hint("merge"), "lang", "left").select("lang", F.coalesce("ids", F.array().cast(active.schema["ids"].dataType)).alias("ids"))


def apply_edits(roster: DataFrame, edits: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """A roster (``meta_id``, ``ord`` and fields) after edits, and the edits refused.

    ``edits`` have ``meta_id, seq, op`` (add, update, delete, clear), ``fields`` map of what
    is set (a key that is absent keeps, a null or blank clears). The last edit of an id
    counts; a clear removes all ids whose last edit is not after it. Added rows need a
    field and room under ``most``; an update that leaves nothing is refused.
    """
    cleared = edits.where("op = 'clear'").agg(F.max("seq").alias("cleared"))
    last = edits.where("op <> 'clear'").groupBy("meta_id").agg(F.max_by(F.struct("op", "fields", "seq"), "seq").alias("e"))
    rows = roster.join(last.hint("merge"), "meta_id", "full").crossJoin(F.broadcast(cleared))
    op, wiped = F.col("e.op"), F.col("cleared").isNotNull()
    late = F.coalesce(F.col("e.seq") > F.col("cleared"), ~wiped)
    new = {}
    for f in FIELDS:
        given = F.coalesce(F.map_contains_key(F.col("e.fields"), F.lit(f)), F.lit(False)) & op.isin("add", "update") & late
        base = F.when(wiped, F.lit(None)).otherwise(F.col(f))
        new[f] = F.when(given, clean_name(F.try_element_at(F.col("e.fields"), F.lit(f)))).otherwise(base)
    was = F.col("ord").isNotNull() & ~wiped
    rows = rows.withColumns(new | {"__was": was, "__op": F.when(late, op), "__seq": F.col("e.seq")})
    some = F.coalesce(*(F.col(f) for f in FIELDS)).isNotNull()
    action = (
        F.when(F.col("__op") == "delete", "gone")
        .when(F.col("__was") & ((F.col("__op").isNull()) | some), "keep")
        .when(F.col("__was"), "refused: nothing left")
        .when((F.col("__op") == "add") & some, "add")
        .when(F.col("__op") == "add", "refused: no field")
        .when(F.col("__op") == "update", "refused: unknown")
        .otherwise("gone")
    )
    rows = rows.withColumn("__action", action)
    kept = materialise(rows.where(F.col("__action").isin("keep", "add")), "edits-kept")
    order = [F.desc("__was"), "ord", "__seq", "meta_id"]
    first = kept.orderBy(*order).limit(most)  # a top of most rows, of which alone the numbers are taken
    first = materialise(first.withColumn("__n", F.row_number().over(Window.orderBy(*order))), "edits-first")
    good = first.select("meta_id", F.col("__n").alias("ord"), *FIELDS)
    full = kept.join(F.broadcast(first.select("meta_id")), "meta_id", "left_anti").select("meta_id", F.lit("refused: full").alias("reason"))
    refused = rows.where(F.col("__action").startswith("refused")).select("meta_id", F.col("__action").alias("reason"))
    return good, refused.unionByName(full)


def resolve_defaults(saved: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per group (``grp, choice``) the saved choice while it is a candidate, else the
    candidate of the lowest rank, else null; ``changed`` tells which differ."""
    first = candidates.groupBy("grp").agg(F.min_by("id", F.struct("rank", "id")).alias("first"))
    there = candidates.select("grp", F.col("id").alias("choice"), F.lit(True).alias("__there")).distinct()
    rows = saved.join(there.hint("merge"), ["grp", "choice"], "left").join(first.hint("merge"), "grp", "left")
    new = F.when(F.col("__there"), F.col("choice")).otherwise(F.col("first"))
    return rows.select("grp", new.alias("choice"), (~new.eqNullSafe(F.col("choice"))).alias("changed"))


def assign_owners(items: DataFrame, owners: list[str], cap: int = 25) -> DataFrame:
    """Owners in order each take their distinct free items (``owner, item, pos``), ``cap``
    at most; what is over an owner's cap stays free for the next. Owners are few (4)."""
    taken = None
    for owner in owners:
        mine = items.where(F.col("owner") == owner).groupBy("item").agg(F.min("pos").alias("pos"))
        if taken is not None:
            mine = mine.join(taken.select("item").hint("merge"), "item", "left_anti")
        top = mine.orderBy("pos", "item").limit(cap).select("item", F.lit(owner).alias("owner"), "pos")
        top = materialise(top, "owner")
        taken = top if taken is None else taken.unionByName(top)
    return taken
