import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import panelspark as ps
from panelspark.functions import full_window
from panelspark.operators.windows import asset_window, long_rolling
from tests.conftest import day

PANEL = "date date, barrid string, price double, return double, daily_volume double"


def walk(assets=2, days=40, seed=1):
    rng = np.random.default_rng(seed)
    return [
        (day(d), a, float(rng.uniform(5, 20)), float(rng.normal(0, 0.02)), float(rng.integers(1, 9)))
        for a in [chr(97 + i) for i in range(assets)]
        for d in range(days)
    ]


def frame(rows):
    return pd.DataFrame(rows, columns=["date", "barrid", "price", "ret", "vol"])


def collected(df, name, key="barrid"):
    return {(r["date"], r[key]): r[name] for r in df.collect()}


def close(got, want):
    if got is None:
        return want is None or math.isnan(want)
    return got == pytest.approx(want, rel=1e-9)


def test_rolling_matches_pandas_and_ignores_row_order(spark):
    rows = walk()
    pdf = frame(rows)
    pdf["x"] = pdf.ret.abs() / (pdf.vol * pdf.price)
    pdf["want"] = pdf.groupby("barrid").x.transform(
        lambda s: np.log1p(s.rolling(22, min_periods=22).mean() * 1e7).shift(2)
    )
    df = spark.createDataFrame(rows[::-1], PANEL).repartition(3)
    got = collected(ps.illiq_rolling(df, "barrid"), "illiq")
    assert len(got) == len(rows)
    for r in pdf.itertuples():
        assert close(got[r.date, r.barrid], r.want)


def test_rolling_recovers_after_a_zero_volume_day(spark):
    rows = [(day(i), "a", 10.0, 0.01, 0.0 if i == 3 else 5.0) for i in range(12)]
    got = collected(
        ps.illiq_rolling(spark.createDataFrame(rows, PANEL), "barrid", window=3, lag=1), "illiq"
    )
    series = [got[day(i), "a"] for i in range(12)]
    assert series[:3] == [None] * 3
    assert series[4:7] == [float("inf")] * 3
    assert series[7] == pytest.approx(math.log1p(1e7 * 0.01 / 50))


def test_exponential_and_volatility_variants_match_pandas(spark):
    rows = walk(days=120)
    rows = [(*r[:3], None if i % 17 == 5 else r[3], r[4]) for i, r in enumerate(rows)]
    pdf = frame(rows)
    pdf["x"] = pdf.ret.abs() / (pdf.vol * pdf.price)
    by = pdf.groupby("barrid")
    pdf["mean"] = by.x.transform(lambda s: s.ewm(span=20, min_periods=20).mean())
    pdf.loc[pdf.x.isna(), "mean"] = np.nan
    pdf["vol20"] = by.ret.transform(lambda s: s.rolling(5, min_periods=5).std())
    pdf["want"] = np.log1p(pdf["mean"] / pdf.vol20 * 1e7)
    pdf["want"] = pdf.groupby("barrid").want.shift(2)
    df = spark.createDataFrame(rows, PANEL)
    got = collected(ps.illiq_rolling(df, "barrid", ewm_span=20, vol_window=5), "illiq")
    assert sum(v is not None for v in got.values()) > 50
    for r in pdf.itertuples():
        assert close(got[r.date, r.barrid], r.want)


def test_momentum_matches_pandas(spark):
    rows = walk(days=60)
    pdf = frame(rows)
    pdf["want"] = pdf.groupby("barrid").ret.transform(
        lambda s: (np.log1p(s).rolling(10).sum() / s.rolling(10).std()).shift(4)
    )
    df = spark.createDataFrame(rows, PANEL)
    got = collected(ps.vol_scaled_momentum(df, window=10, skip=4), "vol_scaled_momentum")
    for r in pdf.itertuples():
        assert close(got[r.date, r.barrid], r.want)


def test_monthly_panel_uses_the_previous_month_row_across_gaps(spark):
    # January has two rows, February none, March one, April one.
    days = ["2020-01-01", "2020-01-02", "2020-03-05", "2020-04-01"]
    rows = [(d, "a", 10.0, 0.1 * (i + 1), 1.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, PANEL.replace("date date", "date string")).withColumn(
        "date", F.to_date("date")
    )
    out = ps.illiq_monthly_panel(df).orderBy("date").collect()
    # the first row has no lagged price, so January's mean covers one value
    assert [r.n_days_lag for r in out] == [None, None, 1, 1]
    assert [r.liquidity for r in out] == [None, None, pytest.approx(0.02), pytest.approx(0.03)]
    assert [r.price_lag for r in out] == [None, 10.0, 10.0, 10.0]


def test_monthly_market_semantics(spark):
    rows = [
        ("2020-01-03", 1, 0.10, -10.0, 5.0),
        ("2020-01-02", 1, 0.20, 10.0, 5.0),
        ("2020-02-03", 1, None, 20.0, 5.0),
        ("2020-03-02", 1, -1.0, 20.0, 0.0),
        ("2020-05-04", 1, 0.5, 20.0, 5.0),
    ]
    df = spark.createDataFrame(
        rows, "d string, permno long, ret double, prc double, vol double"
    ).select(F.to_date("d").alias("date"), "permno", "ret", "prc", "vol")
    out = ps.illiq_monthly_market(df).orderBy("date").collect()
    assert [r.ret for r in out] == [pytest.approx(0.32), 0.0, -1.0, pytest.approx(0.5)]
    assert [r.n_days for r in out] == [2, 1, 1, 1]
    assert [r.n_days_lag for r in out] == [None, 2, 1, 1]
    # negative quotes count by size; an all-null month has no mean; x/0 is infinite
    assert [r.liquidity for r in out] == [None, pytest.approx(0.003), None, float("inf")]
    # price of the row before the month's last row
    assert [r.price_lag for r in out] == [10.0, 10.0, 20.0, 20.0]


def test_composite_is_null_when_a_part_is(spark):
    panel = spark.createDataFrame([(day(i), "a") for i in range(4)], "date date, barrid string")
    loads = spark.createDataFrame(
        [(day(0), "a", 1.0, 2.0), (day(1), "a", None, 2.0), (day(3), "a", 4.0, 4.0)],
        "date date, barrid string, x double, y double",
    )
    out = ps.composite_exposure_signal(panel, loads, ["x", "y"], divisor=4, lag=1)
    assert [r.illiq for r in out.orderBy("date").collect()] == [None, 0.75, None, None]
    flipped = ps.composite_exposure_signal(panel, loads, {"x": -1}, divisor=1, lag=0)
    assert [r.illiq for r in flipped.orderBy("date").collect()] == [-1.0, None, None, -4.0]


def test_forward_returns_units_and_missing_rows(spark):
    df = spark.createDataFrame(walk(assets=1, days=3), PANEL)
    rets = [r["return"] for r in df.orderBy("date").collect()]
    kept = ps.forward_returns(df).orderBy("date").collect()
    assert [r.forward_return for r in kept] == [rets[1] / 100, rets[2] / 100, None]
    dropped = ps.forward_returns(df, percent_units=False, drop_null=True).orderBy("date")
    assert [r.forward_return for r in dropped.collect()] == rets[1:]


def test_universe_rules(spark):
    inf, nan = float("inf"), float("nan")
    values = [0.0, None, nan, inf, -inf, 1.0]
    rows = [(day(i), "a", 5.0 + i, v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(
        rows, "date date, barrid string, price double, s double, n_days_lag int"
    )

    def kept(**rules):
        return [r.n_days_lag for r in ps.universe_filter(df, "barrid", "s", **rules).collect()]

    assert kept(finite="all") == [0, 5]
    assert kept(finite="no_posinf") == [0, 4, 5]
    assert kept(finite="null_only") == [0, 2, 3, 4, 5]
    assert kept(min_price_lag=5.0) == [5]
    assert kept(min_price_lag=4.0) == [5]
    assert kept(min_days_lag=1) == [5]
    with pytest.raises(ValueError):
        kept(finite="sometimes")


def test_first_row_never_passes_a_price_rule(spark):
    df = spark.createDataFrame(
        [(day(0), "a", 9.0, 1.0), (day(1), "a", 1.0, 1.0), (day(2), "a", 9.0, 1.0)],
        "date date, barrid string, price double, s double",
    )
    out = ps.universe_filter(df, "barrid", "s", min_price_lag=5.0).collect()
    assert [r.date for r in out] == [day(1)]


def test_long_frames_match_sliding_frames(spark):
    """Blocks agree with plain frames around missing, infinite and constant stretches."""
    rng = np.random.default_rng(8)
    rows = []
    for a in ("a", "b", "c"):
        for d in range(97 if a != "c" else 9):
            x = float(rng.normal(0, 1) * 10.0 ** rng.integers(-6, 3))
            if d % 41 == 20:
                x = None
            elif d == 60 and a == "b":
                x = math.inf
            elif 30 <= d < 50:
                x = 0.1
            rows.append((day(d), a, x))
    df = spark.createDataFrame(rows, "date date, barrid string, x double")
    order = asset_window("barrid")
    both = long_rolling(df, "barrid", 10, {"s": "x"}, {"d": "x"}).withColumns(
        {
            "s0": full_window(F.sum, "x", order, 10),
            "d0": full_window(F.stddev_samp, "x", order, 10),
        }
    )
    out = both.collect()
    assert len(out) == len(rows) and sum(r.s is not None for r in out) > 100
    assert any(r.d == 0.0 for r in out) and any(r.s == math.inf for r in out)
    for r in out:
        for got, want in ((r.s, r.s0), (r.d, r.d0)):
            if want is None or math.isnan(want):
                assert got is None if want is None else math.isnan(got)
            else:
                assert got == pytest.approx(want, rel=1e-12, abs=1e-13)


@pytest.mark.parametrize("rows", [1, 2, 3, 8, 21, 32, 230])
def test_long_frames_of_any_length(spark, rows):
    """Spans of every pattern of binary digits; a missing value empties the frames it is in."""
    rng = np.random.default_rng(rows)
    values = [None if d == 5 else 1e6 + float(rng.normal(0, 1e-3)) for d in range(300)]
    df = spark.createDataFrame(
        [(day(d), "a", x) for d, x in enumerate(values)], "date date, barrid string, x double"
    )
    out = long_rolling(df, "barrid", rows, {"s": "x"}, {"d": "x"})
    assert out.columns == ["date", "barrid", "x", "s", "d"]
    got = {r.date: r for r in out.collect()}
    for d in range(300):
        spot, part = got[day(d)], values[max(0, d - rows + 1) : d + 1]
        if len(part) < rows or None in part:
            assert spot.s is None and spot.d is None
        else:
            assert spot.s == pytest.approx(math.fsum(part), rel=1e-14)
            # The mean of values around 1e6 is rounded at 1e-10, the deviation is near 1e-3.
            assert spot.d == pytest.approx(np.std(part, ddof=1) if rows > 1 else 0.0, rel=1e-6, abs=1e-12)
