"""A Merkle manifest of a dataset: one tree a partition, the trees' tops under one root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.plans.session import materialise

#: Rows of (task, tree) counts up to which they are broadcast; beyond, they are merged.
BROADCAST_COUNTS = 50_000


def hashed(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, binary."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return hashed(*(field(v) for v in values))


def numbered(rows: DataFrame, tree: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``__idx``, their number from 0 within their tree, and ``__n``, the tree's rows.

    Rows are dealt out by ranges of tree and order, so that a tree of any share of the rows
    is spread over tasks; each task numbers its sorted rows, and the counts of earlier tasks
    (a row for each task and tree) are added. Rows equal in all of ``order`` must be alike.
    """
    by = [*tree, *order]
    spread = materialise(rows.withColumn("__spread", F.monotonically_increasing_id()), f"{label}-rows")
    sorted_rows = spread.repartitionByRange(*by, "__spread").sortWithinPartitions(*by, "__spread")
    placed = materialise(
        sorted_rows.withColumns({
            "__part": F.spark_partition_id(),
            "__pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }).drop("__spread"),
        f"{label}-placed",
    )
    within = Window.partitionBy(*tree)
    counts = placed.groupBy(*tree, "__part").agg(F.count("*").alias("c"), F.min("__pos").alias("first"))
    before = F.sum("c").over(within.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(
        counts.select(*tree, "__part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(within).alias("n")),
        f"{label}-starts",
    )
    starts = starts.hint("broadcast" if starts.count() <= BROADCAST_COUNTS else "merge")
    same = [F.col(f"a.{t}").eqNullSafe(F.col(f"b.{t}")) for t in tree]
    on = F.col("a.__part") == F.col("b.__part")
    for x in same:
        on = on & x
    joined = placed.alias("a").join(starts.alias("b"), on)
    return joined.select("a.*", (F.col("__pos") + F.col("shift")).alias("__idx"), F.col("n").alias("__n")).drop("__part", "__pos")


def _met(nodes: DataFrame, arity: int, label: str) -> DataFrame:
    """Each node with the digests of its run, by an equijoin on sibling indices."""
    run = F.col("idx") - F.col("idx") % arity
    shift = F.explode(F.sequence(F.lit(0), F.lit(arity - 1)))
    asks = nodes.select("tree", "idx", "n", run.alias("run"), shift.alias("k"))
    asks = asks.select("tree", "idx", "n", (F.col("run") + (F.col("idx") + F.col("k")) % arity).alias("sibling"))
    asks = asks.where("sibling < n")
    other = nodes.select("tree", F.col("idx").alias("sibling"), "digest")
    met = asks.hint("merge").join(other, ["tree", "sibling"])
    own = F.max(F.when(F.col("sibling") == F.col("idx"), F.col("digest")))
    found = met.groupBy("tree", "idx", "n").agg(
        own.alias("digest"), F.array_sort(F.collect_list(F.struct("sibling", "digest"))).alias("parts")
    )
    return materialise(found.withColumn("parts", F.transform("parts", lambda x: x["digest"])), label)


def _text(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hex_of), "")


def levels(leaves: DataFrame, arity: int, label: str) -> list[DataFrame]:
    """The levels of all trees over ``tree, idx, n, digest``, leaves first; the last has single nodes alone.

    At each level nodes that are not alone meet their siblings, and the rows in slot 0 give
    the parents. A tree that is down to one node takes no further part. The driver sees only
    the largest tree's count.
    """
    out: list[DataFrame] = []
    live = leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        met = _met(live.where("n > 1"), arity, f"{label}-{len(out)}")
        out.append(met)
        live = met.where(F.col("idx") % arity == 0).select(
            "tree",
            F.floor(F.col("idx") / arity).cast("long").alias("idx"),
            F.ceil(F.col("n") / arity).cast("long").alias("n"),
            hashed(_text(F.col("parts"))).alias("digest"),
        )
        most = -(-most // arity)
    return out


def tops(leaves: DataFrame, found: list[DataFrame], arity: int) -> DataFrame:
    """``tree, digest, height`` of each tree's last node; a single leaf has height 0."""
    out = leaves.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    for depth, nodes in enumerate(found):
        last = nodes.where((F.col("n") <= arity) & (F.col("idx") == 0))
        out = out.unionByName(last.select("tree", hashed(_text(F.col("parts"))).alias("digest"), F.lit(depth + 1).alias("height")))
    return out


def _paths(found: list[DataFrame], above: DataFrame, arity: int, label: str) -> DataFrame:
    """``tree, idx, path`` and what else ``above`` has, for each leaf.

    ``above`` has ``tree, height, path`` of each tree's last node. Going down, a node's path
    is the digests before and after it in its run, ahead of its parent's path.
    """
    extra = [c for c in above.columns if c not in ("tree", "height", "path")]

    def begun(depth: int) -> DataFrame:
        return above.where(F.col("height") == depth).select("tree", F.lit(0).cast("long").alias("idx"), "path", *extra)

    paths = begun(len(found))
    for depth, nodes in reversed(list(enumerate(found))):
        slot = (F.col("idx") % arity).cast("int")
        step = F.struct(
            F.slice("parts", F.lit(1), slot).alias("left"),
            F.slice("parts", slot + 2, F.lit(arity)).alias("right"),
        )
        here = nodes.select("tree", "idx", F.floor(F.col("idx") / arity).cast("long").alias("up"), step.alias("step"))
        ups = paths.select("tree", F.col("idx").alias("up"), "path", *extra)
        down = here.hint("merge").join(ups, ["tree", "up"])
        down = down.select("tree", "idx", F.concat(F.array("step"), F.col("path")).alias("path"), *extra)
        paths = down.unionByName(begun(depth))
        if depth:
            paths = materialise(paths, f"{label}-{depth}")
    return paths


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level and left to right, as hex text."""
    return F.array_join(F.transform(path, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, digest, lambda d, s: hashed(_text(s["left"]), hex_of(d), _text(s["right"])))


def manifest(rows: DataFrame, tree_col: str, order: Sequence[str], digest_col: str = "digest", arity: int = 8) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``path`` (array of ``left``, ``right`` digests a level).

    Each value of ``tree_col`` (null is one) has a tree over its rows' digests by ``order``;
    rows equal in ``order`` follow by digest. Every level is an equijoin of nodes with the
    computed indices of their siblings; slot-zero rows give the parents. The tops of the trees,
    by ``tree_col`` (null first, by bytes), are the leaves of a last tree. Paths come down the
    same levels, a join with the parents' paths each. Digests travel as 32 bytes; keys are
    (tree, index), so no tree, however large, meets in one task.

    Repeated rows are leaves like any other. A single leaf is its tree's top, without siblings;
    an empty table gives none. ``rows`` should hold keys and digests, not texts: they are
    sorted. Columns called ``subroot``, ``root`` or ``path`` are replaced.
    """
    rows = rows.drop("subroot", "root", "path")
    leaves = numbered(rows.withColumn("__tree", F.col(f"`{tree_col}`")), ["__tree"], [*order, digest_col], "merkle-leaves")
    leaves = materialise(leaves, "merkle-leaves")
    names = leaves.select(F.col("__tree").alias("name")).distinct()
    named = numbered(names.withColumn("__all", F.lit(0)), ["__all"], ["name"], "merkle-names")
    named = materialise(named.select("name", F.col("__idx").alias("no")), "merkle-trees")
    trees = named.count()
    same = F.col("a.__tree").eqNullSafe(F.col("b.name"))
    leaves = leaves.alias("a").join(named.alias("b").hint("broadcast" if trees <= BROADCAST_COUNTS else "merge"), same)
    leaves = leaves.select("a.*", F.col("b.no").alias("__no"))

    nodes = leaves.select(F.col("__no").alias("tree"), F.col("__idx").alias("idx"), F.col("__n").alias("n"), F.col(f"`{digest_col}`").alias("digest"))
    found = levels(nodes, arity, "merkle-level")
    subroots = materialise(tops(nodes, found, arity), "merkle-subroots")
    one = F.lit(0).cast("long").alias("tree")
    upper = subroots.select(one, F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest")
    over = levels(upper, arity, "merkle-top-level")
    start = tops(upper, over, arity).select(
        "tree", "height", F.array().cast("array<struct<left:array<binary>,right:array<binary>>>").alias("path"), F.col("digest").alias("root")
    )
    reached = _paths(over, start, arity, "merkle-top-path").select(F.col("idx").alias("tree"), "path", "root")
    tips = subroots.select("tree", "height", F.col("digest").alias("subroot")).hint("merge")
    above = materialise(reached.join(tips, "tree"), "merkle-above")
    paths = _paths(found, above, arity, "merkle-path").select(F.col("tree").alias("__no"), F.col("idx").alias("__idx"), "subroot", "root", "path")
    return leaves.hint("merge").join(paths, ["__no", "__idx"]).drop("__no", "__idx", "__n", "__tree")
