"""Connected components as a loop of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    ``edges`` is undirected; direction, repeats, self loops and rows with a null
    end do not matter. Returns ``node, component`` with one row for each node of
    a non-loop edge; an empty edge table gives an empty result.

    Every round points each node at its smallest neighbour (or itself), follows the
    pointers to their ends by doubling, and contracts the graph onto those ends. An
    end that nobody points at has a smaller neighbour in the next round, so two
    rounds halve the nodes; the pointers of all rounds are then composed. A hub is
    only ever reduced by a map-side ``min`` or split by AQE's skew join, and the
    driver sees nothing but whether rows are left. A graph that has not settled
    after ``max_rounds`` raises instead of returning a partial answer.
    """
    live = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    live = materialise(live, "cc-edges")
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = materialise(
            both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("to")), "cc-point"
        )
        for _ in range(max_rounds):  # a chain of n pointers ends after log2 n doublings
            on = point.select(F.col("node").alias("to"), F.col("to").alias("next")).hint("merge")
            jumped = materialise(point.join(on, "to").select("node", "to", "next"), "cc-point")
            point = jumped.select("node", F.col("next").alias("to"))
            if jumped.where("to <> next").isEmpty():
                break
        steps.append(point)
        a = point.select(F.col("node").alias("u"), F.col("to").alias("a")).hint("merge")
        b = point.select(F.col("node").alias("v"), F.col("to").alias("b")).hint("merge")
        moved = live.join(a, "u").join(b, "v").where("a <> b")
        live = materialise(
            moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-edges"
        )
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    if not steps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    resolved = steps[-1].select("node", F.col("to").alias("component"))
    for step in reversed(steps[:-1]):
        later = resolved.select(F.col("node").alias("to"), F.col("component").alias("final")).hint("merge")
        resolved = step.join(later, "to", "left").select("node", F.coalesce("final", "to").alias("component"))
    return resolved
