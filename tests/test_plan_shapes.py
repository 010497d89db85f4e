"""The physical plans: how often rows are shuffled and what never appears."""

import re

import pytest

import panelspark as ps
from panelspark.catalog import queries as q
from panelspark.catalog.fixtures import frame
from panelspark.sources import stage
from tests.conftest import TINY


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (hash|range|Single)", plan_of(df)))


@pytest.fixture(scope="module")
def assets(spark):
    return stage(frame(spark, TINY, "fx_assets"))


@pytest.fixture(scope="module")
def panel(assets):
    return assets.select("date", "barrid", "price", "return", "daily_volume")


def test_asset_work_shares_one_shuffle(panel):
    signals = ps.illiq_rolling(panel, "barrid")
    kept = ps.universe_filter(signals, "barrid", "illiq", 5.0)
    assert shuffles(kept) == 1
    assert shuffles(ps.illiq_monthly_panel(panel)) == 1
    assert shuffles(ps.vol_scaled_momentum(panel)) == 1
    assert shuffles(ps.forward_returns(panel)) == 1


def test_long_frames_sort_rows_once(panel):
    plan = plan_of(ps.vol_scaled_momentum(panel.select("date", "barrid", "return")))
    assert len(re.findall(r"Sort \[", plan)) == 1


def test_rolling_does_not_carry_unused_columns(panel):
    out = ps.illiq_rolling(panel, "barrid").select("date", "barrid", "illiq")
    exchange = plan_of(out).split("Exchange")[1]
    assert "ReadSchema" in exchange and "ticker" not in exchange


def test_cross_section_rows_are_not_shuffled_by_date(panel):
    scored = ps.zscore_by_date(panel, "price")
    plan = plan_of(scored)
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "SortMergeJoin" not in plan
    assert "partial_avg" in plan  # combined before the one shuffle of moments
    assert shuffles(scored) == 1


def test_weights_need_one_shuffle_of_sums(assets):
    panel = assets.selectExpr("*", "price AS alpha")
    plan = plan_of(ps.mvo_weights(panel))
    assert "Window" not in plan and "partial_sum" in plan
    assert shuffles(ps.mvo_weights(panel)) == 1


def test_bins_read_the_sorted_copy(panel):
    plan = plan_of(ps.quantile_bins(panel, "price", 5, strict=False))
    assert "SortMergeJoin" not in plan
    assert not re.search(r"Window .*price", plan)


def test_no_row_at_a_time_python_and_no_cross_products(spark):
    for name in ("histogram", "quantile_bins", "mvo_weights", "portfolio_returns", "ols_overall"):
        plan = plan_of(q.all_queries()[name](spark, TINY))
        assert "BatchEvalPython" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_factor_solve_runs_on_one_row_per_date(spark):
    plan = plan_of(q.all_queries()["mvo_weights_factor_risk"](spark, TINY))
    assert "BatchEvalPython" not in plan
    # The solve comes first in the plan, then the aggregate by date, then the sums of cross products.
    _, below, rows = plan.split("MapInArrow", 2)
    assert "ObjectHashAggregate" in below and "Scan" in rows


def test_exposure_join_and_lag_can_share_a_shuffle(spark, panel):
    loads = stage(frame(spark, TINY, "fx_exposures").select("date", "barrid", "USSLOWL_VALUE"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    old = {name: spark.conf.get(name) for name in settings}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        signal = ps.composite_exposure_signal(panel, loads, ["USSLOWL_VALUE"])
        assert shuffles(signal) == 3
        for name, value in settings.items():
            spark.conf.set(name, value)
        signal = ps.composite_exposure_signal(panel, loads, ["USSLOWL_VALUE"])
        assert shuffles(signal) == 2
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
