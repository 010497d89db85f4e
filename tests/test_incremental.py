"""Runs that go on from carried rows against runs over the whole history."""

import datetime as dt
import math

import numpy as np
import pytest

import panelspark as ps
from panelspark import plans
from panelspark.operators.signals import EWM_STATE
from panelspark.sources import StateError, load_assets

PANEL = (
    "date date, barrid string, price double, return double, daily_volume double, "
    "specific_risk double, predicted_beta double, in_universe boolean"
)
YEARS = (2018, 2019, 2020)


@pytest.fixture(scope="module")
def rows():
    """Gaps, missing values, a zero volume, an asset that skips a year and one that comes late."""
    rng = np.random.default_rng(8)
    out = []
    for asset in range(14):
        for offset in range(3 * 365):
            date = dt.date(2018, 1, 1) + dt.timedelta(days=offset)
            if date.weekday() > 4 or rng.random() < 0.3:
                continue
            if (asset == 3 and date.year == 2019) or (asset == 5 and date < dt.date(2019, 12, 20)):
                continue
            ret = None if rng.random() < 0.03 else float(rng.normal(0, 2))
            risk = None if rng.random() < 0.02 else float(rng.uniform(10, 40))
            out.append((
                date, f"a{asset}", float(rng.uniform(4, 30)), ret, float(rng.uniform(10, 500)),
                risk, float(rng.uniform(0.5, 1.5)), rng.random() > 0.02,
            ))
    return out


@pytest.fixture(scope="module")
def panel(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "assets")
    spark.createDataFrame(rows, PANEL).repartition(3).write.parquet(path)
    return path


def of(df, name):
    return {(r.date, r.barrid): r[name] for r in df.collect()}


def close(ours, theirs, rel=1e-9):
    assert ours.keys() == theirs.keys()
    for k, want in theirs.items():
        got = ours[k]
        if want is None or got is None or math.isnan(want) or math.isinf(want):
            assert repr(got) == repr(want), k
        else:
            assert got == pytest.approx(want, rel=rel, abs=1e-13), k


def year_of(df, year):
    return df.where(f"year(date) = {year}")


@pytest.mark.parametrize(
    "look",
    [{}, {"window": 5, "lag": 1}, {"vol_window": 40}, {"ewm_span": 10}, {"ewm_span": 200, "vol_window": 9}],
    ids=str,
)
def test_carried_rows_give_the_signal_of_the_whole_history(spark, rows, look):
    bad = [(*r[:4], 0.0, *r[5:]) if r[1] == "a7" and r[0] == dt.date(2018, 6, 4) else r for r in rows]
    bad += [(dt.date(2018, 6, 4), "a9", 10.0, 1.0, 0.0, 20.0, 1.0, True)] * (
        not any(r[1] == "a9" and r[0] == dt.date(2018, 6, 4) for r in rows)
    )
    df = spark.createDataFrame(bad, PANEL).drop("in_universe")
    whole = ps.illiq_rolling(df, "barrid", **look)
    held = year_of(df, 2018).limit(0)
    carried = {}
    names = df.columns + (list(EWM_STATE) if "ewm_span" in look else [])
    for year in YEARS:
        joined = held.unionByName(year_of(df, year), allowMissingColumns=True)
        signal = year_of(ps.illiq_rolling(joined, "barrid", **look), year)
        carried |= of(signal, "illiq")
        tail = ps.illiq_tail(joined, **look)
        schema, kept = tail.schema, tail.collect()
        assert tail.columns == names
        held = spark.createDataFrame(kept, schema)
    close(carried, of(whole, "illiq"))


def test_carried_months_give_the_panel_of_the_whole_history(spark, rows):
    df = spark.createDataFrame(rows, PANEL)
    whole = ps.illiq_monthly_panel(df)
    held = year_of(df, 2018).limit(0)
    parts = []
    for year in YEARS:
        joined = held.unionByName(year_of(df, year))
        parts.append(year_of(ps.illiq_monthly_panel(joined), year))
        tail = ps.month_tail(joined)
        held = spark.createDataFrame(tail.collect(), tail.schema)
    for name in ("liquidity", "n_days_lag", "price_lag"):
        close({k: v for p in parts for k, v in of(p, name).items()}, of(whole, name))


def test_tail_keeps_assets_without_new_rows(spark, rows):
    df = spark.createDataFrame(rows, PANEL)
    first = year_of(df, 2018)
    tail = ps.illiq_tail(first)
    after = ps.illiq_tail(tail.unionByName(year_of(df, 2019)))
    want = sorted(r[0] for r in rows if r[1] == "a3" and r[0].year == 2018)[-23:]
    assert sorted(r.date for r in after.where("barrid = 'a3'").collect()) == want
    assert after.groupBy("barrid").count().agg({"count": "max"}).first()[0] == 23


@pytest.mark.parametrize(
    "extend, study",
    [
        (plans.extend_illiq_backtest, plans.study_illiq_backtest),
        (plans.extend_monthly_illiq_backtest, plans.study_monthly_illiq_backtest),
    ],
)
def test_years_added_one_by_one_equal_one_run(spark, panel, tmp_path, extend, study):
    path = str(tmp_path / "weights")
    extend(spark, panel, path, 2018, fresh=True)
    extend(spark, panel, path, 2019)
    extend(spark, panel, path, 2020)
    whole = study(spark, panel, dt.date(2018, 1, 1), dt.date(2020, 12, 31)).weights()
    want = of(whole, "weight")
    assert any(v is not None for v in want.values())
    stored = extend(spark, panel, path, 2020)  # a repeated year replaces itself
    close(of(stored, "weight"), want)


def test_exponential_sums_go_on_from_stored_state(spark, panel, tmp_path):
    options = {"ewm_span": 30, "vol_window": 12}
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    want = plans.extend_illiq_backtest(spark, panel, whole, 2018, 2020, fresh=True, **options)
    plans.extend_illiq_backtest(spark, panel, parts, 2018, 2019, fresh=True, **options)
    got = plans.extend_illiq_backtest(spark, panel, parts, 2020, **options)
    close(of(got, "weight"), of(want, "weight"), 1e-6)


def test_a_state_that_is_missing_or_cut_short_is_refused(spark, panel, tmp_path):
    path = str(tmp_path / "weights")
    with pytest.raises(StateError):
        plans.extend_illiq_backtest(spark, panel, path, 2019)
    plans.extend_illiq_backtest(spark, panel, path, 2018, fresh=True)
    with pytest.raises(StateError):  # other parameters, other state
        plans.extend_illiq_backtest(spark, panel, path, 2019, window=5)
    (mark,) = (tmp_path / "weights" / "_state").glob("*/as_of=2018/_SUCCESS")
    mark.unlink()
    with pytest.raises(StateError):
        plans.extend_illiq_backtest(spark, panel, path, 2019)


def test_a_new_year_reads_its_own_rows(spark, panel, tmp_path):
    from panelspark.plans.incremental import _state_path, _years_with_state

    path = str(tmp_path / "weights")
    plans.extend_illiq_backtest(spark, panel, path, 2018, 2019, fresh=True)
    state = _state_path(path, "illiq-22-2-None-None", 2019)
    df = _years_with_state(spark, panel, state, 2020, 2020, True)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2020-01-01)" in text and "LessThanOrEqual(date,2020-12-31)" in text
    members = load_assets(spark, panel, dt.date(2020, 1, 1), dt.date(2020, 12, 31), ["barrid"])
    assert df.count() - members.count() <= 23 * 14
    limited = ps.illiq_tail(df)._jdf.queryExecution().executedPlan().toString()
    assert limited.count("WindowGroupLimit") == 2
