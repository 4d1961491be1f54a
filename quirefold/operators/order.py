"""Order and window operators: reading order, context windows, budgets, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quirefold.functions import text as T
from quirefold.plans.session import spread
from quirefold.streaming.state import in_order


def orientation(boxes: DataFrame, by: str) -> DataFrame:
    """Per group whether its boxes (centre x, y, size w, h) read vertically.

    Boxes half again as high as wide (1.3 times) vote vertical, the other way round
    horizontal, near squares do not vote; a tie goes by the block's shape, then to
    horizontal.
    """
    up, across = F.count_if(F.col("h") >= 1.3 * F.col("w")), F.count_if(F.col("w") >= 1.3 * F.col("h"))
    width = F.max(F.col("x") + F.col("w") / 2) - F.min(F.col("x") - F.col("w") / 2)
    height = F.max(F.col("y") + F.col("h") / 2) - F.min(F.col("y") - F.col("h") / 2)
    return boxes.groupBy(by).agg(
        F.when(up > across, "vertical").when(across > up, "horizontal").when(height > width, "vertical").otherwise("horizontal").alias("orientation")
    )


def read_lines(boxes: DataFrame, by: str, box: str) -> DataFrame:
    """Boxes in reading order: ``line``, ``place`` in the line, ``nth`` in the group.

    Centres within half the median height (width, for columns) of the one before are
    in one line. Horizontal lines run top to bottom, each left to right; vertical ones
    right to left, each top to bottom.
    """
    w = Window.partitionBy(by)
    way = orientation(boxes, by)
    rows = boxes.join(way.hint("merge"), by)
    vertical = F.col("orientation") == "vertical"
    rows = rows.withColumns(
        {
            "__at": F.when(vertical, -F.col("x")).otherwise(F.col("y")),
            "__thick": F.when(vertical, F.col("w")).otherwise(F.col("h")),
        }
    )
    tolerance = rows.groupBy(by).agg((F.expr("percentile(__thick, 0.5)") / 2).alias("__tol"))
    rows = rows.join(tolerance.hint("merge"), by)
    along = w.orderBy("__at", box)
    gap = F.col("__at") - F.lag("__at").over(along)
    rows = rows.withColumn("__new", F.when(gap.isNull() | (F.col("__tol") <= 0) | (gap > F.col("__tol")), 1).otherwise(0))
    rows = rows.withColumn("line", F.sum("__new").over(along))
    inside = [F.when(vertical, F.col("y")).otherwise(F.col("x")), F.when(vertical, F.col("x")).otherwise(F.col("y")), F.col(box)]
    return rows.withColumns(
        {
            "place": F.row_number().over(Window.partitionBy(by, "line").orderBy(*inside)),
            "nth": F.row_number().over(w.orderBy("line", *inside)),
        }
    ).drop("__at", "__thick", "__tol", "__new")


def read_text(boxes: DataFrame, by: str, box: str, text: str) -> DataFrame:
    """Each group's texts in reading order, joined without a separator."""
    rows = read_lines(boxes, by, box)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nth", text))), lambda s: s[text])
    return rows.groupBy(by).agg(T.normalise_ocr(F.array_join(parts, "")).alias("text"))


def reading_order(regions: DataFrame, by: str, box: str, right_to_left: bool = False) -> DataFrame:
    """Regions (box x1, y1, x2, y2) of a page in reading order, as ``nth``.

    Taken from the top by their centres, a region joins the latest row if its centre
    is within half the median positive height of that row's running mean, else it
    begins a row. Rows go by mean; within a row by centre x, then y, then id.
    Regions without area come last by id. The mean depends on all regions before, so Spark
    sorts a page's regions and they pass one at a time beside the state of one row: a page of
    any size takes no memory.
    """
    area = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    rows = regions.withColumns({"__cx": (F.col("x1") + F.col("x2")) / 2, "__cy": (F.col("y1") + F.col("y2")) / 2, "__ok": area})
    good = rows.where("__ok")
    tol = good.groupBy(F.col(by).alias("__by")).agg((F.expr("percentile(y2 - y1, 0.5)") / 2).cast("double").alias("__tol"))
    good = good.hint("merge").join(tol, F.col(by).eqNullSafe(F.col("__by")))
    good = good.select(by, box, F.col("__cx").cast("double").alias("__cx"), F.col("__cy").cast("double").alias("__cy"), "__tol")

    def step(state: tuple, item: dict) -> tuple:
        row, n, mean = state
        y = item["__cy"]
        if not n or abs(y - mean) > item["__tol"]:
            return (row + 1, 1, y), row + 1
        return (row, n + 1, mean + (y - mean) / (n + 1)), row

    placed = in_order(good, by, ["__cy", box], lambda: (0, 0, 0.0), step, "row", T_.IntegerType())
    mean = F.avg("__cy").over(Window.partitionBy(by, "row"))
    x = F.desc("__cx") if right_to_left else F.asc("__cx")
    placed = placed.withColumn("__mean", mean)
    flat = rows.where("NOT __ok").select(by, box, F.lit(1 << 30).alias("row"), "__cy", F.lit(0.0).alias("__cx"), F.lit(float("inf")).alias("__mean"))
    every = placed.select(by, box, "row", "__cy", "__cx", "__mean").unionByName(flat)
    last = F.when(F.col("row") == 1 << 30, F.lit(0.0)).otherwise(F.col("__cy"))
    w = Window.partitionBy(by).orderBy("__mean", "row", x, last, box)
    return every.select(by, box, F.row_number().over(w).alias("nth"))


def renumber(df: DataFrame, by: str, pos: str, out: str = "number") -> DataFrame:
    """Place of each entry in its page, from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(pos)))


def nudge(df: DataFrame, by: str, pos: str, marked: str, direction: int = 1) -> DataFrame:
    """Each marked entry changes places with its neighbour; at the ends it stays.

    Neighbouring marks are not allowed to overlap; ``pos`` becomes the new place.
    """
    w = Window.partitionBy(by).orderBy(pos)
    there, back = (F.lead, F.lag) if direction > 0 else (F.lag, F.lead)
    moved = F.when(F.col(marked) & there(pos).over(w).isNotNull(), there(pos).over(w)).when(back(marked).over(w), back(pos).over(w))
    return df.withColumn(pos, F.coalesce(moved, F.col(pos)))


def compact_layers(df: DataFrame, by: str, pos: str, layer: str = "layer", most: int = 10) -> DataFrame:
    """``rank`` 1..k of the layer, clamped to 1..``most``; ``ceiling``, one more than the
    highest layer of the others, clamped; ``paint``, the order of painting."""
    w = Window.partitionBy(by)
    c = F.least(F.greatest(F.floor(F.col(layer) + F.lit(0.5)), F.lit(1)), F.lit(most)).cast("int")
    rows = df.withColumn("__layer", c)
    rows = rows.withColumns(
        {
            "rank": F.dense_rank().over(w.orderBy("__layer")),
            "paint": F.row_number().over(w.orderBy("__layer", pos)),
            "__down": F.row_number().over(w.orderBy(F.desc("__layer"), pos)),
        }
    )
    rows = rows.withColumns(
        {"__top": F.max("rank").over(w), "__second": F.max(F.when(F.col("__down") > 1, F.col("rank"))).over(w)}
    )
    others = F.when(F.col("__down") == 1, F.coalesce("__second", F.lit(0))).otherwise(F.col("__top"))
    return rows.withColumn("ceiling", F.least(others + 1, F.lit(most)).cast("int")).drop("__layer", "__down", "__top", "__second")


def context(entries: DataFrame, by: str, pos: str, source: str, english: str, speaker: str, n: int = 10, cut: int = 1000) -> DataFrame:
    """The newest ``n`` valid pairs strictly before each entry of a page, oldest first.

    A pair is valid if visible (``visible``, where there is one) and neither side is
    blank; sides are collapsed and cut to ``cut`` characters. Pairs get an ordinal, an
    entry the number of those before it, and the two are joined on a range of ordinals
    bucketed by ``n``: each entry meets two buckets at most, never its whole page.
    Returns the page, the position and ``context``: array of (source, english, speaker).
    """
    seen = F.col("visible") if "visible" in entries.columns else F.lit(True)
    s, e = (F.substring(T.collapse(F.col(c)), 1, cut) for c in (source, english))
    rows = entries.select(
        by, pos, s.alias("__s"), e.alias("__e"), F.col(speaker).alias("__k"),
        (seen & (F.length(s) > 0) & (F.length(e) > 0)).alias("__valid"),
    )
    rows = rows.withColumn("__valid", F.coalesce("__valid", F.lit(False)).cast("int"))
    before = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__c", F.coalesce(F.sum("__valid").over(before), F.lit(0)))
    pairs = rows.where("__valid = 1").select(
        F.col(by).alias("__by"), (F.col("__c") + 1).alias("__ord"), "__s", "__e", "__k", F.floor((F.col("__c")) / n).alias("__bucket")
    )
    targets = rows.select(by, pos, "__c").withColumn(
        "__b", F.explode(F.array_distinct(F.array(F.floor((F.col("__c") - n) / n), F.floor((F.col("__c") - 1) / n))))
    )
    met = targets.join(
        pairs.hint("merge"),
        F.expr(f"{by} = __by AND __b = __bucket AND __ord <= __c AND __ord > __c - {n}"),
        "left",
    )
    item = F.when(F.col("__ord").isNotNull(), F.struct("__ord", F.col("__s").alias("source"), F.col("__e").alias("english"), F.col("__k").alias("speaker")))
    grouped = met.groupBy(by, pos).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    return grouped.select(
        by, pos, F.transform("__items", lambda x: F.struct(x["source"], x["english"], x["speaker"])).alias("context")
    )


def pack_recent(pairs: DataFrame, by: str, pos: str, cost: Column, budget: int) -> DataFrame:
    """Newest first while costs fit; the first that does not drops it and all older.
    Costs are positive, so that is a limit on the running sum."""
    w = Window.partitionBy(by).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    return pairs.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def to_ranges(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sorted distinct integers as runs ``first``, ``last``; one shuffle, of tasks of bounded size."""
    rows = spread(df.select(by, value), by).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(by).orderBy(value))
    runs = rows.withColumn("__island", island).groupBy(by, "__island")
    return runs.agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("__island")


def face_runs(chars: DataFrame, by: str, pos: str, face: str) -> DataFrame:
    """Runs of consecutive characters with one face: ``run``, its face, ``start`` and ``length``."""
    w = Window.partitionBy(by).orderBy(pos)
    new = (~F.col(face).eqNullSafe(F.lag(face).over(w)) | F.lag(pos).over(w).isNull()).cast("int")
    rows = chars.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return rows.groupBy(by, "run").agg(F.first(face).alias(face), F.min(pos).alias("start"), F.count("*").alias("length"))


def text_face_runs(docs: DataFrame, by: str, text: str, faces: dict[str, list[tuple[int, int]]], missing: str = "missing") -> DataFrame:
    """W9 of whole texts: as ``face_runs``, with the first of ``faces`` whose ranges of code points
    hold a character as its face, else ``missing``.

    A run is one match of a character class, so there is a row for each run and none for a
    character; only the runs of a text are shuffled, to sum their lengths. ``by`` tells
    texts apart; null and empty texts have no runs.
    """

    def members(ranges: list[tuple[int, int]]) -> str:
        return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)

    classes, seen, face = [], "", F.lit(missing)
    for ranges in faces.values():
        classes.append(f"[{members(ranges)}&&[^{seen}]]+" if seen else f"[{members(ranges)}]+")
        seen += members(ranges)
    first = F.ascii("__run")
    for name, ranges in reversed(faces.items()):
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | first.between(a, b)
        face = F.when(inside, name).otherwise(face)
    pattern = "|".join([*classes, f"[^{seen}]+"])
    rows = docs.select(by, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("__i", "__run"))
    rows = rows.select(by, (F.col("__i") + 1).cast("long").alias("run"), face.alias("face"), F.length("__run").cast("long").alias("length"))
    through = F.sum("length").over(Window.partitionBy(by).orderBy("run"))
    return rows.withColumn("start", through - F.col("length") + 1).select(by, "run", "face", "start", "length")


def recent(df: DataFrame, key: str, order: list, n: int = 200) -> DataFrame:
    """The newest record of each key, newest first, ``n`` at most, as ``place``.

    The cut is a top-n, taken in each task and merged; only the n rows are numbered.
    """
    newest = df.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")
    top = newest.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def latest_attempt(jobs: DataFrame, name: str, attempt: str) -> DataFrame:
    """The row of the highest attempt of each job."""
    cols = [c for c in jobs.columns if c != name]
    return jobs.groupBy(name).agg(F.max_by(F.struct(*cols), attempt).alias("s")).select(name, "s.*")


def first_n_distinct(df: DataFrame, by: list[str], key: str, order: str, n: int) -> DataFrame:
    """The first row of each key in a group, and of these the first ``n`` in order, as ``place``."""
    once = df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by, key).orderBy(order))).where("__nth = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return placed.where(F.col("place") <= n).drop("__nth")


def even_sample(df: DataFrame, by: str, order: str, k: int = 48) -> DataFrame:
    """All of a group of ``k`` or fewer, else the items at floor(i (n - 1) / (k - 1))."""
    w = Window.partitionBy(by)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    # item j is floor(i (n-1) / (k-1)) of some i exactly for i = ceil(j (k-1) / (n-1))
    i = F.ceil(F.col("__i") * (k - 1) / (F.col("__n") - 1))
    taken = (F.col("__n") <= k) | (F.floor(i * (F.col("__n") - 1) / (k - 1)) == F.col("__i"))
    return rows.where(taken).drop("__i", "__n")


def spreads(pages: DataFrame, by: str, pos: str) -> DataFrame:
    """``spread`` of each page and its ``side``: the first and landscape pages
    (0 < height / width <= 1) alone, others in pairs, an odd one alone.

    Pages that stand alone cut runs; in a run the pair is half the place.
    """
    w = Window.partitionBy(by).orderBy(pos)
    first = F.row_number().over(w) == 1
    wide = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("height") <= F.col("width"))
    rows = pages.withColumn("__alone", (first | F.coalesce(wide, F.lit(False))).cast("int")).withColumn("__run", F.sum("__alone").over(w))
    inside = Window.partitionBy(by, "__run", "__alone").orderBy(pos)
    rows = rows.withColumn("__k", F.row_number().over(inside) - 1).withColumn("__pair", F.floor(F.col("__k") / 2))
    spread = F.dense_rank().over(Window.partitionBy(by).orderBy("__run", F.desc("__alone"), "__pair"))
    return rows.withColumns({"spread": spread, "side": (F.col("__k") % 2).cast("int")}).drop("__alone", "__run", "__k", "__pair")


def rank_catalogue(df: DataFrame, name: str, priorities: list, family: str, order: str) -> DataFrame:
    """One row a name, the first kept; ``by`` gives what to sort by: two priorities,
    the lowered family, the name."""
    once = df.withColumn("__nth", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("__nth = 1").drop("__nth")
    return once.withColumn("sort_key", F.struct(*(p.alias(f"p{i}") for i, p in enumerate(priorities)), F.lower(family).alias("family"), F.col(name).alias("name")))


def search(df: DataFrame, words: str, fields: list[str], code: str, offset: int, limit: int) -> DataFrame:
    """K1: rows with ``words`` in one of the fields whatever the case, by code, one page of
    them, each with ``total``, the number of all. Blank words match all."""
    low = words.strip().lower()
    hit = F.lit(not low)
    for f in fields:
        hit = hit | F.lower(F.coalesce(F.col(f), F.lit(""))).contains(low)
    found = df.where(hit)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(code).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def trim_request(requests: DataFrame, n_ctx: int = 2048, max_new: int = 512, overhead: int = 128) -> DataFrame:
    """What of each request's roster and pairs fits in the window.

    Input: ``req_id, text, speaker, pairs array<struct(source, english, speaker)>``,
    oldest first, ``roster array<struct(meta_id, ...)>``, ids unique; every other field
    of a roster row is a string, and all but ``gender`` are names. The last 10 pairs and
    the first 50 rows count, rows without any field do not. Cost is UTF-8 bytes and
    ``overhead``. While it is over n_ctx - max_new - 4, the first of these goes: a
    roster row that nothing refers to, lowest priority first; the oldest pair; the lowest
    row left, but never the current speaker's. The text refers to a row by one of its
    names, a kept pair by its speaker. Priority: speaker, named in the text, recent speakers
    (latest first), others, and so by place. Nothing left to drop is an error.

    What goes next never depends on the costs: rows referred to by nothing, then each pair
    and the row that only it and older ones refer to, then the named ones. So a request is
    one sorted array and one running sum, within its row. Kept rows stay in roster order.
    """
    fields = [f.name for f in requests.schema["roster"].dataType.elementType.fields if f.name != "meta_id"]
    names = [f for f in fields if f != "gender"]
    text = F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")

    def size(*parts: Column) -> Column:
        return sum((F.octet_length(F.coalesce(p, F.lit(""))) for p in parts), F.lit(0))

    def named(r: Column) -> Column:
        hit = F.lit(False)
        for f in names:
            hit = hit | F.coalesce((r[f] != "") & F.contains(text, r[f]), F.lit(False))
        return hit

    def row_item(r: Column, i: Column) -> Column:
        heard = F.array_max(F.transform("__pairs", lambda p, k: F.when(p["speaker"] == r["meta_id"], k + 1).otherwise(0)))
        stage = F.when(r["meta_id"].eqNullSafe(F.col("speaker")) & r["meta_id"].isNotNull(), 99).when(named(r), 98)
        stage = stage.otherwise(F.coalesce(heard, F.lit(0)))
        return F.struct(stage.alias("stage"), F.lit(1).alias("kind"), (-i).alias("place"), size(*(r[f] for f in fields)).alias("cost"), r["meta_id"].alias("meta_id"))

    def pair_item(p: Column, k: Column) -> Column:
        return F.struct((k + 1).alias("stage"), F.lit(0).alias("kind"), F.lit(0).alias("place"), size(p["source"], p["english"]).alias("cost"), none.alias("meta_id"))

    pairs = F.coalesce("pairs", F.array().cast(requests.schema["pairs"].dataType))
    roster = F.coalesce("roster", F.array().cast(requests.schema["roster"].dataType))
    some = lambda r: F.coalesce(*(F.nullif(r[f], F.lit("")) for f in fields)).isNotNull()
    rows = requests.select("req_id", "text", "speaker", pairs.alias("__pairs"), F.filter(F.slice(roster, 1, 50), some).alias("__roster"))
    rows = rows.withColumn("__pairs", F.slice("__pairs", F.greatest(F.size("__pairs") - 9, F.lit(1)), 10))
    rows = rows.withColumn("__items", F.array_sort(F.concat(F.transform("__pairs", pair_item), F.transform("__roster", row_item))))
    total = F.aggregate("__items", size(text) + overhead, lambda t, x: t + x["cost"])
    start = F.struct((total - (n_ctx - max_new - 4)).alias("over"), F.lit(0).alias("n"))
    goes = lambda s, x: (s["over"] > 0) & (x["stage"] < 99)
    cut = F.aggregate("__items", start, lambda s, x: F.when(goes(s, x), F.struct((s["over"] - x["cost"]).alias("over"), (s["n"] + 1).alias("n"))).otherwise(s))
    rows = rows.withColumn("__cut", cut).withColumn("__kept", F.filter("__items", lambda x, i: i >= F.col("__cut.n")))
    fits = F.col("__cut.over") <= 0
    in_order = F.array_sort(F.transform(F.filter("__kept", lambda x: x["kind"] == 1), lambda x: F.struct((-x["place"]).alias("place"), x["meta_id"].alias("meta_id"))))
    return rows.select(
        "req_id",
        F.when(fits, F.size(F.filter("__kept", lambda x: x["kind"] == 0))).otherwise(0).alias("kept_pairs"),
        F.when(fits, F.transform(in_order, lambda x: x["meta_id"])).otherwise(F.array().cast("array<string>")).alias("kept_roster"),
        (F.col("__cut.over") + (n_ctx - max_new - 4)).cast("int").alias("cost"),
        F.when(~fits, "does not fit").alias("error"),
    )
