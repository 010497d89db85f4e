"""Rows that must not get lost, and frames that must not be cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import panelspark as ps
from panelspark.catalog import queries
from panelspark.catalog.fixtures import frame
from panelspark.operators.signals import _ewm_mean
from panelspark.sources import scope, stage, staging
from tests.conftest import TINY, day


@pytest.mark.parametrize("table", ["fx_market_daily", "fx_assets", "fx_exposures"])
def test_no_panel_row_lies_outside_the_study_window(spark, table):
    outside = ~F.col("date").between(queries.START, queries.END)
    assert frame(spark, TINY, table).where(outside).isEmpty()


def test_null_groups_keep_their_rows(spark):
    rows = [(None, "a", 1.0), (None, "b", 2.0), (day(0), "a", 1.0), (day(0), "b", 3.0)]
    df = spark.createDataFrame(rows, "date date, permno string, x double")
    for out in (
        ps.quantile_bins(df, "x", 2),
        ps.rank_quantile_bins(df, "x", 2),
        ps.zscore_by_date(df, "x"),
    ):
        assert out.count() == 4
    assert {r.bin for r in ps.quantile_bins(df, "x", 2).collect()} == {"0", "1"}


@pytest.mark.parametrize("method", ["rank", "pearson"])
def test_nan_pairs_do_not_count(spark, method):
    alphas = [(day(0), f"a{i}", float(i)) for i in range(5)] + [(day(0), "a9", math.nan)]
    rets = [(day(0), f"a{i}", 2.0 * i) for i in range(5)] + [(day(0), "a9", 1.0)]
    row = ps.information_coefficients(
        spark.createDataFrame(alphas, "date date, barrid string, alpha double"),
        spark.createDataFrame(rets, "date date, barrid string, fwd_return double"),
        method,
    ).first()
    assert (row.n_assets, row.ic) == (5, pytest.approx(1.0))


@pytest.mark.parametrize("span, count, level", [(3, 5000, None), (66, 12_000, None), (3, 1200, 1e5)])
def test_exponential_mean_of_long_histories(spark, span, count, level):
    rng = np.random.default_rng(1)
    values = [None if level is None and rng.random() < 0.02 else level or float(rng.random()) for _ in range(count)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, date int, v double")
    got = [r.v for r in _ewm_mean(df, "v", "k", span, span).orderBy("date").collect()]
    decay, top, bottom, seen = (span - 1) / (span + 1), 0.0, 0.0, 0
    for value, ours in zip(values, got):
        top, bottom = top * decay, bottom * decay
        if value is None:
            assert ours is None
            continue
        top, bottom, seen = top + value, bottom + 1, seen + 1
        assert ours == (pytest.approx(top / bottom, rel=1e-9) if seen >= span else None)


def test_a_singular_date_only_loses_its_own_weights(spark):
    rows = [(day(d), f"a{i}", float(i), 1.0 + 0.1 * i * i, 1.0) for d in range(2) for i in range(5)]
    alphas = spark.createDataFrame(
        rows, "date date, barrid string, alpha double, predicted_beta double, specific_risk double"
    )
    # A name with a quote; the covariance of -1 / 5 makes the first date singular.
    loads = spark.createDataFrame([(r[0], r[1], 1.0) for r in rows], "date date, barrid string, `it's` double")
    risk = spark.createDataFrame(
        [(day(0), "it's", "it's", -0.2), (day(1), "it's", "it's", 0.1)],
        "date date, factor_1 string, factor_2 string, covariance double",
    )
    got = ps.mvo_weights(alphas, risk="factor", exposures=loads, covariances=risk).toPandas()
    assert got[got.date == day(0)].weight.isna().all()
    assert got[got.date == day(1)].weight.notna().all()


def test_bins_run_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for part in frames:
            seen.add(len(part))
            yield part

    rows = [(day(d), f"a{i}", float(i)) for d in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, permno string, x double")
    ps.quantile_bins(df.mapInPandas(count, df.schema), "x", 4).collect()
    assert seen.value == len(rows)
    ps.rank_quantile_bins(df.mapInPandas(count, df.schema), "x", 4).collect()
    assert seen.value == 2 * len(rows)


def test_a_scope_deletes_its_own_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "staging_root", lambda session: str(tmp_path))
    outer = stage(spark.range(2))
    with scope(spark):
        assert stage(spark.range(3)).count() == 3
        staging.new_path(spark, "weights")
    assert outer.count() == 2
    assert len(list((tmp_path / "panelspark").glob("*/*"))) == 1
