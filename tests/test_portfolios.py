import math

import numpy as np
import pytest

import panelspark as ps
from tests.conftest import day

BINS = "date date, bin string, return double"


def test_spread_completes_every_date(spark):
    df = spark.createDataFrame(
        [(day(0), "0", 0.1), (day(0), "2", 0.5), (day(1), "1", 0.2)], BINS
    )
    got = {(r.date, r.bin): r["return"] for r in ps.spread_returns(df, 3).collect()}
    assert len(got) == 8
    assert got[day(0), "spread"] == pytest.approx(0.4)
    assert got[day(0), "1"] is None
    assert got[day(1), "spread"] is None


def test_bin_means_skip_missing_returns(spark):
    df = spark.createDataFrame(
        [(day(0), "0", 0.1), (day(0), "0", None), (day(0), "0", 0.3), (day(0), "1", None)], BINS
    )
    got = {r.bin: r["return"] for r in ps.bin_returns(df).collect()}
    assert got == {"0": pytest.approx(0.2), "1": None}


def test_vol_target_reaches_the_target(spark):
    rng = np.random.default_rng(5)
    rows = [(day(i), b, float(rng.normal(0, s))) for b, s in [("0", 0.01), ("1", 0.1)] for i in range(50)]
    out = ps.vol_target(spark.createDataFrame(rows, BINS))
    for r in ps.performance_summary(out, "bin").collect():
        assert r.volatility == pytest.approx(0.05)
        assert r.sharpe == pytest.approx(r.mean_return / 0.05)


def test_cumulative_keeps_null_rows_and_fills_them_wide(spark):
    df = spark.createDataFrame(
        [(day(0), "0", 0.1), (day(1), "0", None), (day(2), "0", 0.2), (day(2), "1", -1.0)], BINS
    )
    curve = ps.cumulative_log_return(df)
    got = {(r.date, r.bin): r.cumulative_return for r in curve.collect()}
    assert got[day(0), "0"] == pytest.approx(100 * math.log1p(0.1))
    assert got[day(1), "0"] is None
    assert got[day(2), "0"] == pytest.approx(100 * (math.log1p(0.1) + math.log1p(0.2)))
    assert got[day(2), "1"] == -math.inf
    wide = ps.cumulative_wide_ffill(curve, ["0", "1"]).orderBy("date").collect()
    assert wide[1]["0"] == wide[0]["0"]
    assert wide[0]["1"] is None


def test_single_series_needs_no_label(spark):
    df = spark.createDataFrame([(day(i), 0.1) for i in range(3)], "date date, return double")
    out = ps.cumulative_log_return(df, ()).orderBy("date").collect()
    assert out[2].cumulative_return == pytest.approx(300 * math.log1p(0.1))
    assert ps.performance_summary(df, periods=12).first().mean_return == pytest.approx(1.2)


def test_summary_order_and_half_even_rounding(spark):
    df = spark.createDataFrame(
        [(day(0), "0", 0.25), (day(1), "0", 0.25), (day(0), "spread", 1.0)], BINS
    )
    rows = ps.performance_summary(df, "bin", periods=1, digits=1).collect()
    assert [r.bin for r in rows] == ["spread", "0"]
    assert rows[1].mean_return == 0.2
    assert rows[0].volatility is None and math.isinf(rows[1].sharpe)


def test_portfolio_returns_count_missing_as_zero(spark):
    weights = spark.createDataFrame(
        [(day(0), "a", 0.5, "s"), (day(0), "b", -0.5, "s"), (day(1), "c", 1.0, "s"), (day(0), "a", 2.0, "t")],
        "date date, barrid string, weight double, signal string",
    )
    rets = spark.createDataFrame(
        [(day(0), "a", 0.1), (day(0), "b", None)],
        "date date, barrid string, forward_return double",
    )
    by_date = {r.date: r["return"] for r in ps.portfolio_returns(weights, rets).collect()}
    assert by_date == {day(0): pytest.approx(0.25), day(1): 0.0}
    both = ps.portfolio_returns(weights, rets, ("date", "signal")).collect()
    assert {(r.date, r.signal): r["return"] for r in both} == {
        (day(0), "s"): pytest.approx(0.05),
        (day(1), "s"): 0.0,
        (day(0), "t"): pytest.approx(0.2),
    }


@pytest.mark.parametrize("bins", [4, 50])
def test_histogram_matches_numpy(spark, bins):
    x = np.random.default_rng(2).exponential(size=400)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.inf,)], "x double")
    counts, edges = np.histogram(x, bins=bins)
    rows = ps.histogram(df, "x", bins).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.lo for r in rows] == pytest.approx(edges[:-1].tolist())
    assert [r.hi for r in rows] == pytest.approx(edges[1:].tolist())


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    rows = ps.histogram(df, "x", 5).orderBy("bin").collect()
    counts, edges = np.histogram([2.0] * 3, bins=5)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.lo for r in rows] == pytest.approx(edges[:-1].tolist())


def test_exposure_values_drop_incomplete_rows(spark):
    df = spark.createDataFrame(
        [(day(0), 1.0), (day(0), None), (None, 3.0), (day(1), 1.0), (day(1), float("nan"))],
        "date date, x double",
    )
    values = [r.x for r in ps.exposure_values(df, "x").collect()]
    assert len(values) == 2 and 1.0 in values and any(math.isnan(v) for v in values)
