"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.plans.session import materialise

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A per-source table of at most so many rows is broadcast; beyond, joins are by merging.
BROADCAST_SOURCES = 10_000
#: About so many documents of one source are ordered in one task.
BUCKET_ROWS = 5_000
#: Measures that differ by less than a fiftieth count as one.
MEASURE_STEPS = 50
#: So often the words that a sample leaves are sampled for again.
REFILLS = 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, n`` with ``target``: words wanted from each source.

    Sources in order of code points, null last, weigh ``weights``, repeating. They
    divide ``share`` times all words by weight; a target stops at ``most`` times its
    source's words and the excess is divided again by weight until none is above.
    That settles where each target is min(most * size, c * weight) for one level c,
    found from running sums over the sources in order of most * size / weight. One
    row per source is ordered here, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(0.0)
    for i, x in enumerate(weights):
        w = F.when(F.col("place") % len(weights) == i, F.lit(float(x))).otherwise(w)
    s = (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("w", w)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("w"))
    )
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    s = s.withColumn("nth", F.row_number().over(by_level))  # of sources that are full at one level, the first decides
    s = s.withColumn("c", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("nth", "level"))).over(everything))
    return s.select(
        "source",
        "source_size",
        "n",
        F.coalesce(F.least(F.col("cap"), F.col("c.level") * F.col("w")), F.col("cap")).alias("target"),
    )


def expected_copies(measures: DataFrame, most: float) -> DataFrame:
    """``source, level``: the level at which ``least(most, level * measure)`` copies of each
    document give the source's ``target`` words.

    ``measures`` has a row per source and measure: ``source, target, measure, words``. From
    the largest measure down, those that would be above ``most`` stop there; the rest share
    what is left. The level is null where ``most`` copies of all do not exceed the target.
    """
    down = Window.partitionBy("source").orderBy(F.desc("measure"))
    before, on = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    got = measures.where("measure > 0").withColumn(
        "level",
        (F.col("target") - float(most) * F.coalesce(F.sum("words").over(before), F.lit(0)))
        / F.nullif(F.sum(F.col("words") * F.col("measure")).over(on), F.lit(0.0)),
    )
    fits = F.col("level") * F.col("measure") <= float(most)
    return got.groupBy("source").agg(F.max(F.when(fits, F.struct("measure", "level")))["level"].alias("level"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__no``, their number among those of one ``__like``.

    Most rows are alone and 0. The others are written with their task and place; each task's
    own are numbered after those of the tasks before, so that a third of all rows may be alike.
    """
    counts = rows.groupBy("__like").agg(F.count("*").alias("c")).where("c > 1").select("__like")
    repeated = materialise(counts, "mix-repeated")
    n = repeated.count()
    if not n:
        return rows.withColumn("__no", F.lit(0).cast("long"))
    repeated = repeated.hint("broadcast" if n <= BROADCAST_SOURCES else "merge")
    alone = rows.join(repeated, "__like", "left_anti").withColumn("__no", F.lit(0).cast("long"))
    some = rows.join(repeated, "__like", "left_semi")
    some = some.withColumns({"__task": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    some = materialise(some, "mix-alike")
    before = Window.partitionBy("__like").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy("__like", "__task").agg(F.count("*").alias("c"))
    starts = starts.select("__like", "__task", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__like", "__task").orderBy("__place")) - 1
    some = some.withColumn("__no", own).join(starts.hint("merge"), ["__like", "__task"])
    some = some.withColumn("__no", F.col("__no") + F.col("__start")).drop("__task", "__place", "__start")
    return alone.unionByName(some)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size_col: str | None = None,
    weight_col: str | None = None,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    tilt: float = 0.5,
    with_expected: bool = False,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` (and ``expected`` if wished).

    Each document of a source is to be taken ``expected`` times: in proportion to its
    measure, at most ``most`` times, and so that the source gives ``target`` words. The
    measure is ``weight_col`` where that is given (null or not positive: never taken), else
    the size to the power ``tilt``, so that fewer and longer documents carry a source's
    words; 0 makes all alike. The whole part of ``expected`` is allocated as certain
    copies. Its fraction p is the document's inclusion probability in a Pareto order
    sample: with u a number in (0, 1) hashed from the document, documents are taken in
    order of (u / (1 - u)) / (p / (1 - p)) until the words that the certain copies leave
    are reached. The one at the cut is passed over if it is longer than what is left; the
    words it leaves are filled in the same order from documents that fit (``REFILLS``
    times), and one more document, of any length, may close the gap: that whose size is
    nearest to it. ``taken`` is copies * size.

    A cut is found without ordering a source in one task: a histogram of the ranking
    variable, about ``BUCKET_ROWS`` documents a bucket, gives the bucket where the words
    run out, and only that one is ordered. Sizes come from ``size_col``, or else are the
    words of ``text_col``. Nothing is drawn at random, so reruns agree. Rows alike in id,
    source, size and text are numbered and each has its own draw, so that a source of equal rows
    is sampled as any other; which of them are taken is open. Null sources are a source; null and empty texts have no words and
    are never in a sample by size; an empty table gives none. Existing columns of
    these names are replaced.
    """
    size = F.col(size_col).cast("long") if size_col else word_count(F.col(text_col))
    size = F.coalesce(size, F.lit(0).cast("long"))
    like = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(source_col), size, F.col(text_col) if text_col in docs.columns else F.lit(0))
    rows = _numbered(docs.withColumns({"__source": F.col(source_col), "__size": size, "__like": like}))
    tie = F.when(F.col("__no") == 0, F.col("__like")).otherwise(F.xxhash64("__like", "__no"))
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), "__tie"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("__tie", tie).withColumn("__u", unit).drop("__like", "__no")
    weight = F.col(weight_col).cast("double") if weight_col else F.pow(F.col("__size").cast("double"), F.lit(float(tilt)))
    step = F.floor(F.log(weight) * MEASURE_STEPS)
    measure = F.when((weight > 0) & (F.col("__size") > 0), F.exp(step / MEASURE_STEPS)).otherwise(F.lit(0.0))
    rows = rows.withColumn("__measure", measure)
    slim = materialise(rows.select("__source", "__size", "__tie", "__u", "__measure"), "mix-slim")
    measures = slim.groupBy(F.col("__source").alias("source"), F.col("__measure").alias("measure")).agg(
        F.sum("__size").alias("words"), F.count("*").alias("n")
    )
    measures = materialise(measures, "mix-measures")
    per_source = measures.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    aims = materialise(targets(per_source, weights, share, most), "mix-targets")
    hint = "broadcast" if aims.count() <= BROADCAST_SOURCES else "merge"
    aimed = measures.select(F.col("source").alias("s1"), "measure", "words").join(aims.hint(hint), F.expr("s1 <=> source"))
    levels = materialise(expected_copies(aimed.select("source", "target", "measure", "words"), most), "mix-levels")
    levels = aims.join(levels.select(F.col("source").alias("s2"), "level").hint(hint), F.expr("source <=> s2"), "left")

    def expected(level: Column, of: Column) -> Column:
        return F.when(of > 0, F.least(F.lit(float(most)), F.coalesce(level, F.lit(float("inf"))) * of)).otherwise(F.lit(0.0))

    sure = aimed.join(levels.select(F.col("source").alias("s3"), "level").hint(hint), F.expr("s1 <=> s3")).groupBy("s1")
    sure = sure.agg(F.sum(F.floor(expected(F.col("level"), F.col("measure"))) * F.col("words")).alias("sure"))
    plan = levels.join(sure.hint(hint), F.expr("source <=> s1")).select(
        F.col("source").alias("__s1"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        F.col("level").alias("__level"),
        F.greatest(F.col("target") - F.col("sure"), F.lit(0.0)).alias("__left0"),
        F.ceil(F.col("n") / BUCKET_ROWS).alias("__buckets"),
    )
    plan = materialise(plan, "mix-plan")

    def ranked(df: DataFrame) -> DataFrame:
        """With the certain copies, the ranking variable mapped to (0, 1), and its bucket."""
        joined = df.join(plan.hint(hint), F.expr("__source <=> __s1"), "left")
        joined = joined.withColumn("__expected", expected(F.col("__level"), F.col("__measure")))
        p = F.col("__expected") - F.floor("__expected")
        q = (F.col("__u") / (1 - F.col("__u"))) / (p / (1 - p))
        at = F.when(p > 0, q / (1 + q))
        return joined.withColumn("__at", at).withColumn("__bucket", F.floor(F.col("__at") * F.col("__buckets")))

    cuts: list[DataFrame] = []

    def sampled(df: DataFrame) -> DataFrame:
        """With ``__in``, whether the sample so far has the row, and the words left to its source."""
        out = ranked(df).withColumn("__in", F.lit(False))
        for k, cut in enumerate(cuts):
            out = out.join(cut.hint(hint), F.expr(f"__source <=> __c{k}"), "left")
            # a source without a cut takes all that there is
            inside = F.coalesce(
                F.col(f"__bucket{k}").isNull()
                | (F.col("__bucket") < F.col(f"__bucket{k}"))
                | ((F.col("__bucket") == F.col(f"__bucket{k}")) & (F.struct("__at", "__tie") <= F.col(f"__last{k}"))),
                F.lit(False),
            )
            can = F.col("__at").isNotNull() & (F.col("__size") <= F.col(f"__left{k}"))
            can = F.col("__at").isNotNull() if k == 0 else can
            out = out.withColumn("__in", F.col("__in") | (can & inside))
            out = out.withColumn(f"__left{k + 1}", F.coalesce(F.col(f"__left{k}") - F.col(f"__reached{k}"), F.lit(0.0)))
        return out

    rest = ranked(slim).where("__at IS NOT NULL").select(
        "__source", "__at", "__tie", "__bucket", "__size", F.col("__left0").alias("__left")
    )
    lefts, spare = [], []
    for k in range(1 + REFILLS):
        rest = materialise(rest, f"mix-rest-{k}")
        buckets = rest.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__words"), F.first("__left").alias("__left"))
        buckets = materialise(buckets, f"mix-buckets-{k}")
        through = F.sum("__words").over(Window.partitionBy("__source").orderBy("__bucket"))
        over = (
            buckets.withColumn("__through", through)
            .where("__through > __left")
            .groupBy("__source")
            .agg(F.min(F.struct("__bucket", (F.col("__through") - F.col("__words")).alias("before"))).alias("cut"))
            .select(F.col("__source").alias("__c"), F.col("cut.__bucket").alias("__cut"), "cut.before")
        )
        over = materialise(over, f"mix-over-{k}")
        edge = rest.join(over.hint(hint), F.expr("__source <=> __c AND __bucket = __cut")).withColumn(
            "__through", F.col("before") + F.sum("__size").over(Window.partitionBy("__source").orderBy("__at", "__tie"))
        )
        last = edge.where("__through <= __left").groupBy(F.col("__source").alias("__s4")).agg(
            F.max(F.struct("__at", "__tie")).alias("last"), F.max("__through").alias("reached")
        )
        cut = over.join(last.hint("merge"), F.expr("__c <=> __s4"), "left").select(
            F.col("__c").alias(f"__c{k}"),
            F.col("__cut").alias(f"__bucket{k}"),
            F.col("last").alias(f"__last{k}"),
            F.coalesce("reached", "before").alias(f"__reached{k}"),
        )
        cut = materialise(cut, f"mix-cut-{k}")
        cuts.append(cut)
        had = buckets.groupBy("__source").agg(F.sum("__words").alias("all"), F.first("__left").alias("had"))
        had = had.join(cut.hint(hint), F.expr(f"__source <=> __c{k}"), "left")
        lefts.append(had.select("__source", F.lit(k).alias("round"), (F.col("had") - F.coalesce(f"__reached{k}", "all")).alias("gap")))
        # beyond the cut, of sources that have one
        beyond = (F.col("__bucket") > F.col(f"__bucket{k}")) | (
            (F.col("__bucket") == F.col(f"__bucket{k}"))
            & F.coalesce(F.struct("__at", "__tie") > F.col(f"__last{k}"), F.lit(True))
        )
        left = F.col("__left") - F.col(f"__reached{k}")
        rest = rest.join(cut.hint(hint), F.expr(f"__source <=> __c{k}")).where(beyond & (F.col("__size") < 2 * left))
        rest = rest.select("__source", "__at", "__tie", "__bucket", "__size", left.alias("__left"))
        spare.append(rest if k == REFILLS else rest.where("__size > __left"))
        rest = rest.where("__size <= __left")
    # one more row of those that no cut took may come nearer
    gaps = lefts[0]
    for more in lefts[1:]:
        gaps = gaps.unionByName(more)
    gaps = gaps.groupBy(F.col("__source").alias("__s6")).agg(F.max_by("gap", "round").alias("gap"))
    left_over = spare[0]
    for more in spare[1:]:
        left_over = left_over.unionByName(more)
    left_over = left_over.join(gaps.hint(hint), F.expr("__source <=> __s6"))
    miss = F.abs(F.col("__size") - F.col("gap"))
    closing = materialise(
        left_over.where(miss < F.col("gap")).groupBy(F.col("__source").alias("__s5")).agg(
            F.min(F.struct(miss.alias("miss"), "__at", "__tie")).alias("__close")
        ),
        "mix-closing",
    )
    full = sampled(rows).join(closing.hint(hint), F.expr("__source <=> __s5"), "left")
    extra = F.col("__in") | F.coalesce(
        (F.col("__at") == F.col("__close.__at")) & (F.col("__tie") == F.col("__close.__tie")), F.lit(False)
    )
    copies = F.least(F.floor("__expected") + extra.cast("long"), F.lit(int(most)).cast("long"))
    new = {
        "size": F.col("__size"),
        "source_size": F.col("__source_size").cast("long"),
        "target": F.col("__target").cast("double"),
        "copies": copies,
        "taken": copies * F.col("__size"),
    }
    if with_expected:
        new["expected"] = F.col("__expected")
    keep = [c for c in docs.columns if c not in new]
    return full.select(*(F.col(f"`{c}`") for c in keep), *(v.alias(k) for k, v in new.items()))


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of a mix as often as it is taken, with the given columns."""
    return mixed.where("copies > 0").select(
        *columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")
    ).drop("__copy")
