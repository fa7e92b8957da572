"""Queries whose rows are dealt over a stated number of tasks, at a size where all of them are, against their SQL."""

import pytest
from test_queries import FOLDER, canonical, duck  # noqa: F401

from gneiss.functions import stats
from gneiss.operators import deal, history, rollup, structure
from gneiss.plans import bindings

DEALT = ["cochange_partner", "cochange_pairs", "churn_by_subject", "rank_metrics", "change_radius", "radius_totals", "step_tree", "timeline", "token_jaccard", "churn_kind_totals", "boundary_interactions"]


@pytest.mark.parametrize("name", DEALT)
def test_dealt(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(deal, "LEAST_ROWS", 0)
    monkeypatch.setattr(deal, "TASK_ROWS", 1000)
    df = bindings.queries()[name](spark, FOLDER)
    # Spark puts no such partitions together, whatever their size.
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert canonical(df.toPandas()) == canonical(duck.sql(bindings.oracle_sql()[name]).df())


def test_small_tables_are_left_to_spark(spark):
    df = spark.range(10)
    assert deal.deal(df, 10, "id") is df and deal.deal(df, None, "id") is df
    assert deal.deal(df, 10_000_000, "id").rdd.getNumPartitions() == 40


def test_distributions_equal_the_aggregates(spark):
    rows = [(k, v) for k, n in (("a", 1), ("b", 20), (None, 40), ("c", 333)) for v in [None, *[float((i * 7919) % (n + 3) // 2) for i in range(n)]]] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = df.groupBy("k").agg(*stats.aggregate("v"), *stats.distribution("v", "spread")[:2])
    got = rollup.distributions(df, ["k"], "v", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "median": 0.5}).select(*want.columns)
    # No aggregate holds all values of a group.
    assert "percentile_disc" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_totals_by_kind_with_nulls(spark):
    rows = [("x", 1, 1, 2), ("x", 1, 2, 3), ("y", 1, 1, 4), ("y", None, 3, 5), (None, 2, None, 6)]
    df = spark.createDataFrame(rows, "kind string, e int, s int, p int")
    out = history.totals_by_kind(df, history.History("e", "s", "a", "t", "p"), "kind")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("x", 1, 2, 5), ("y", 1, 2, 9), (None, 1, 0, 6), (None, 2, 3, 20)], key=str)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_boundary_counts_no_row_twice(spark):
    rows = [(1, 2, i % 3, i % 5) for i in range(20)] + [(1, 3, None, 1), (1, 3, 4, None)]
    out = structure.boundary(spark.createDataFrame(rows, "c int, s int, site int, symbol int"), "c", "s", "site", "symbol")
    assert sorted(map(tuple, out.collect())) == [(1, 2, 3, 20, 5, 0.35, 0.2), (1, 3, 1, 2, 1, 0.5, 0.5)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
