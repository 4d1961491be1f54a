"""Work is dealt to tasks of bounded size, however small the file or the bytes it comes from."""

from quirefold.operators import aggregate, order
from quirefold.plans import join_queries, session
from quirefold.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("REPARTITION_BY_NUM"), plan.count("ENSURE_REQUIREMENTS")


def test_tasks_follow_the_rows(spark):
    rows = spark.range(1000).selectExpr("id % 50 AS k", "id AS v")
    assert session.spread(rows, "k", each=100).rdd.getNumPartitions() == 10
    assert session.spread(rows, "k").rdd.getNumPartitions() == 4
    assert session.spread(rows.limit(0), "k").count() == 0


def test_ranges_take_one_shuffle_that_is_not_coalesced(spark):
    rows = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (1, 2), (1, 9), (None, 4)], "k int, v int")
    got = order.to_ranges(rows, "k", "v")
    assert exchanges(got) == (1, 0)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, 3), (1, 9, 9), (None, 4, 4)]


def test_robust_medians_take_one_shuffle_that_is_not_coalesced(spark):
    rows = spark.createDataFrame([(1, 10.0), (1, 11.0), (1, 11.0), (1, 500.0), (1, None), (2, -1.0)], "k int, v double")
    got = aggregate.robust_median(rows, "k", "v")
    assert exchanges(got) == (1, 0)
    assert [tuple(r) for r in got.collect()] == [(1, 11.0, 3)]


def test_sizes_are_fitted_in_every_task(spark):
    assert QUERIES["k2_fit_size"](spark, SF).rdd.getNumPartitions() == 4


def test_cells_of_crops_are_made_in_every_task(spark, monkeypatch):
    seen = {}

    def crops(clusters, holes, pages, page, box):
        seen.update(holes=holes, clusters=clusters)
        return clusters.selectExpr("page", "box_id", "0 AS margin", "x1 AS left", "y1 AS top", "x2 AS right", "y2 AS bottom", "0.5D AS share", "1 AS rank")

    monkeypatch.setattr(join_queries.crops, "cluster_crops", crops)
    QUERIES["n2_cluster_crops"](spark, SF)
    assert seen["holes"].rdd.getNumPartitions() == 4
