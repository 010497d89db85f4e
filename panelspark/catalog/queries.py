"""One runnable query per operator and study, over the panels derived from the given tables.

Every query reads whole tables, but for those of loaders, which read a date range. Results are rounded at the edge so that two engines that add
floats in different orders agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import panelspark as ps
from panelspark import plans
from panelspark.catalog.fixtures import frame
from panelspark.functions import illiq_daily, market_cap
from panelspark.sources import (
    clustered_joins,
    load_assets,
    load_covariances,
    load_exposures,
    load_factors,
    load_market_daily,
    new_path,
    read_weights,
    stage,
    write_alphas,
    write_panel,
    write_weights,
)

Query = Callable[[SparkSession, str], DataFrame]

# The studies span the supplied tables; loaders, whose feature is a date range, cut a part.
START, END = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
SHORT_START, SHORT_END = dt.date(1995, 1, 1), dt.date(1997, 12, 31)
# An asset has about 6.5 rows a month here, so a 15-day minimum would keep nothing.
MIN_DAYS = 5
COMPOSITE = ("USSLOWL_EARNQLTY", "USSLOWL_PROFIT", "USSLOWL_VALUE")
SELECTION = {"illiq": 50.0, "liquidity": 6000.0}


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column and turn negative zero into zero."""

    def edge(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            value = F.round(value, digits) + 0.0
        return value.alias(field.name)

    return df.select(*[edge(f) for f in df.schema.fields])


# Panels ------------------------------------------------------------------------------


def _universe(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Universe members with decimal returns and risk."""
    names = ["date", "barrid", *columns]
    out = load_assets(spark, frame(spark, sf, "fx_assets"), columns=names)
    percent = [c for c in ("return", "specific_risk") if c in columns]
    return out.withColumns({c: F.col(c) / 100.0 for c in percent})


def _illiq(spark: SparkSession, sf: str, *columns: str, **options) -> DataFrame:
    needed = ["price", "return", "daily_volume", *columns]
    return ps.illiq_rolling(_universe(spark, sf, *needed), "barrid", **options)


def _illiq_kept(spark: SparkSession, sf: str) -> DataFrame:
    kept = ps.universe_filter(
        _illiq(spark, sf), "barrid", "illiq", min_price_lag=5.0, finite="no_posinf"
    )
    return kept.select("date", "barrid", "return", "illiq")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    kept = ps.universe_filter(
        _illiq(spark, sf, "specific_risk", "predicted_beta"),
        "barrid",
        "illiq",
        min_price_lag=5.0,
        not_null=("specific_risk", "predicted_beta"),
    ).select("date", "barrid", "predicted_beta", "specific_risk", "illiq")
    return ps.zscore_by_date(stage(kept), "illiq")


def _alphas(spark: SparkSession, sf: str) -> DataFrame:
    return ps.alphas(_scored(spark, sf))


def _bins(spark: SparkSession, sf: str) -> DataFrame:
    return ps.quantile_bins(
        _illiq_kept(spark, sf), "illiq", 5, strict=False, tiebreak=["barrid"]
    )


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    return ps.spread_returns(ps.bin_returns(_bins(spark, sf)), 5)


def _targeted(spark: SparkSession, sf: str) -> DataFrame:
    return ps.vol_target(_spread(spark, sf))


def _monthly_market(spark: SparkSession, sf: str) -> DataFrame:
    return ps.illiq_monthly_market(frame(spark, sf, "fx_market_daily"))


def _regression_frame(spark: SparkSession, sf: str) -> DataFrame:
    factors = ps.lead_factors(frame(spark, sf, "fx_factors"))
    return ps.regression_frame(_targeted(spark, sf), factors)


def _forward(spark: SparkSession, sf: str, **options) -> DataFrame:
    assets = frame(spark, sf, "fx_assets")
    return ps.forward_returns(
        load_assets(spark, assets, columns=["date", "barrid", "return"]), **options
    )


# Sources and sinks -------------------------------------------------------------------


def q_load_assets(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["date", "barrid", "ticker", "price", "return", "specific_risk"]
    source = frame(spark, sf, "fx_assets")
    return rounded(load_assets(spark, source, SHORT_START, SHORT_END, columns), 12)


def q_load_exposures(spark: SparkSession, sf: str) -> DataFrame:
    source = frame(spark, sf, "fx_exposures")
    columns = ["date", "barrid", *COMPOSITE]
    return rounded(load_exposures(spark, source, SHORT_START, SHORT_END, columns))


def q_load_exposures_in_universe(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["date", "barrid", *COMPOSITE]
    return rounded(
        load_exposures(
            spark,
            frame(spark, sf, "fx_exposures"),
            SHORT_START,
            SHORT_END,
            columns,
            in_universe=True,
            universe=frame(spark, sf, "fx_assets"),
        )
    )


def q_load_market_daily(spark: SparkSession, sf: str) -> DataFrame:
    source = frame(spark, sf, "fx_market_daily")
    columns = ["date", "permno", "cusip", "primaryexch", "ret", "prc", "vol", "shrout"]
    return rounded(load_market_daily(spark, source, SHORT_START, SHORT_END, columns), 12)


def q_load_factors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(load_factors(spark, frame(spark, sf, "fx_factors"), SHORT_START, SHORT_END))


def q_write_alphas(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "alphas")
    write_alphas(_alphas(spark, sf), path, "illiq")
    return rounded(
        spark.read.parquet(path).select("date", "barrid", "alpha", "signal", "year")
    )


def _store(spark: SparkSession, sf: str, path: str) -> None:
    scored = stage(_alphas(spark, sf))
    for signal, gamma in SELECTION.items():
        write_weights(ps.mvo_weights(scored, gamma=gamma), path, signal, gamma)
    # A second gamma of the same signal, so that a reader has to choose.
    write_weights(ps.mvo_weights(scored, gamma=99.0), path, "illiq", 99.0)


def q_write_weights(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "weights")
    scored = stage(_alphas(spark, sf))
    write_weights(ps.mvo_weights(scored, gamma=10.0), path, "illiq", 50.0)
    rerun = scored.where(F.year("date") == 1996)
    write_weights(ps.mvo_weights(rerun, gamma=50.0), path, "illiq", 50.0)
    return rounded(spark.read.parquet(path).select("date", "barrid", "weight", "year"))


def q_read_weights(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "weights")
    _store(spark, sf, path)
    return rounded(
        read_weights(spark, path, ["illiq"], [50.0, 99.0], SHORT_START, SHORT_END), 10
    )


TABLE_KEYS = {
    "fx_assets": ["date", "barrid"],
    "fx_market_daily": ["date", "permno"],
    "fx_exposures": ["date", "barrid"],
    "fx_factors": ["date"],
    "lineitem": ["l_shipdate", "l_suppkey"],  # the raw rows of the panels, with repeated keys
}


# Panels that an aggregate of lineitem derives inside the report's own job.
DERIVED = ("fx_assets", "fx_market_daily", "fx_exposures")
KEYS_PER_TASK = 500_000


def q_key_report(spark: SparkSession, sf: str) -> DataFrame:
    # A panel has no more keys than lineitem has rows, whose number Parquet files state. Two pieces
    # at least: reports on a single partition would all join the last task.
    pieces = 2 + frame(spark, sf, "lineitem").count() // KEYS_PER_TASK
    reports = [
        ps.key_report(
            frame(spark, sf, name), keys, partitions=pieces if name in DERIVED else None
        ).withColumn("table", F.lit(name))
        for name, keys in TABLE_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, reports)


def q_key_violations(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("asset")]
    return ps.key_violations(frame(spark, sf, "lineitem").select(*keys), ["date", "asset"])


def q_refuse_repeats(spark: SparkSession, sf: str) -> DataFrame:
    rows = load_assets(spark, frame(spark, sf, "fx_assets"), columns=["date", "barrid", "return"])
    return rounded(ps.forward_returns(ps.refuse_repeats(rows)))


# Signals -----------------------------------------------------------------------------


def q_illiq_daily(spark: SparkSession, sf: str) -> DataFrame:
    panel = _universe(spark, sf, "price", "return", "daily_volume")
    value = illiq_daily("return", "daily_volume", "price")
    return rounded(panel.select("date", "barrid", value.alias("illiq")), 12)


def q_illiq_monthly_market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_monthly_market(spark, sf), 10)


def q_illiq_monthly_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = _universe(spark, sf, "price", "return", "daily_volume")
    monthly = ps.illiq_monthly_panel(panel)
    return rounded(
        monthly.select("date", "barrid", "price_lag", "raw_liq", "liquidity", "n_days_lag"),
        12,
    )


def q_illiq_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_illiq(spark, sf).select("date", "barrid", "illiq"))


def q_illiq_rolling_ewm(spark: SparkSession, sf: str) -> DataFrame:
    out = _illiq(spark, sf, ewm_span=66)
    return rounded(out.select("date", "barrid", "illiq"), 8)


def q_illiq_rolling_vol_scaled(spark: SparkSession, sf: str) -> DataFrame:
    out = _illiq(spark, sf, window=66, vol_window=66)
    return rounded(out.select("date", "barrid", "illiq"), 8)


def q_vol_scaled_momentum(spark: SparkSession, sf: str) -> DataFrame:
    out = ps.vol_scaled_momentum(_universe(spark, sf, "return"))
    return rounded(out.select("date", "barrid", "vol_scaled_momentum"), 8)


def q_composite_exposure_signal(spark: SparkSession, sf: str) -> DataFrame:
    exposures = frame(spark, sf, "fx_exposures")
    return rounded(ps.composite_exposure_signal(_universe(spark, sf), exposures))


def _bucketed(spark: SparkSession, df: DataFrame) -> DataFrame:
    return write_panel(df, new_path(spark, "panel"))


def q_composite_exposure_signal_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    assets = _bucketed(spark, _universe(spark, sf))
    exposures = _bucketed(spark, frame(spark, sf, "fx_exposures"))
    with clustered_joins(spark):
        return stage(rounded(ps.composite_exposure_signal(assets, exposures, bucketed=True)))


def q_reversed_exposure_signal(spark: SparkSession, sf: str) -> DataFrame:
    exposures = frame(spark, sf, "fx_exposures")
    reversed_liquidity = {"USSLOWL_LIQUIDTY": -1.0}
    signal = ps.composite_exposure_signal(
        _universe(spark, sf), exposures, reversed_liquidity, divisor=1.0
    )
    return rounded(signal.select("date", "barrid", "illiq"))


def q_market_cap(spark: SparkSession, sf: str) -> DataFrame:
    market = frame(spark, sf, "fx_market_daily")
    return market.select("date", "permno", market_cap("shrout", "prc").alias("market_cap"))


def q_universe_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = ps.universe_filter(
        _illiq(spark, sf, "specific_risk", "predicted_beta"),
        "barrid",
        "illiq",
        min_price_lag=12.0,
        finite="no_posinf",
        not_null=("specific_risk", "predicted_beta"),
    )
    return rounded(kept.select("date", "barrid", "predicted_beta", "illiq"))


def q_exchange_filter(spark: SparkSession, sf: str) -> DataFrame:
    market = frame(spark, sf, "fx_market_daily")
    kept = ps.exchange_filter(market).select("date", "permno", "primaryexch", "ret")
    return rounded(kept)


def q_exposure_values(spark: SparkSession, sf: str) -> DataFrame:
    exposures = frame(spark, sf, "fx_exposures")
    chosen = load_exposures(
        spark, exposures, columns=["date", "barrid", "USSLOWL_PROFIT", "USSLOWL_EARNQLTY"]
    )
    return rounded(ps.exposure_values(chosen, "USSLOWL_PROFIT"))


# Cross-section and portfolios --------------------------------------------------------


def q_quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _bins(spark, sf).select("date", "barrid", "bin")


def q_rank_quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    kept = ps.universe_filter(
        _monthly_market(spark, sf), "permno", "liquidity", min_days_lag=MIN_DAYS
    ).select("date", "permno", "liquidity")
    return ps.rank_quantile_bins(kept, "liquidity", 5).select("date", "permno", "bin")


def q_zscore_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf).select("date", "barrid", "score"), 8)


def q_signal_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.signal_stats(_illiq_kept(spark, sf), "illiq", ("date", "barrid")))


def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.histogram(stage(_illiq_kept(spark, sf)), "illiq"), 8)


def q_bin_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.bin_returns(_bins(spark, sf)))


def q_spread_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_spread(spark, sf))


def q_vol_target(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_targeted(spark, sf))


def q_cumulative_log_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.cumulative_log_return(_targeted(spark, sf)), 7)


def q_cumulative_wide_ffill(spark: SparkSession, sf: str) -> DataFrame:
    labels = ["0", "1", "2", "3", "4", "spread"]
    wide = ps.cumulative_wide_ffill(ps.cumulative_log_return(_targeted(spark, sf)), labels)
    return rounded(wide.withColumnsRenamed({b: f"bin_{b}" for b in labels}), 7)


def q_performance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.performance_summary(_targeted(spark, sf), "bin"), 8)


def q_performance_summary_rounded(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.performance_summary(_targeted(spark, sf), "bin", digits=4), 4)


def q_performance_summary_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.performance_summary(_targeted(spark, sf)), 8)


# Regression --------------------------------------------------------------------------


def q_lead_factors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.lead_factors(frame(spark, sf, "fx_factors")))


def q_regression_frame(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_regression_frame(spark, sf))


def q_ols_by_group(spark: SparkSession, sf: str) -> DataFrame:
    fitted = ps.ols_by_group(
        _regression_frame(spark, sf), "return_rf", ps.THREE_FACTORS, "bin"
    )
    return rounded(fitted, 7)


def q_ols_by_group_qr(spark: SparkSession, sf: str) -> DataFrame:
    returns = _regression_frame(spark, sf)
    return rounded(ps.ols_by_group(returns, "return_rf", ps.THREE_FACTORS, "bin", method="qr"), 7)


def q_ols_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        ps.ols_by_group(_regression_frame(spark, sf), "return_rf", ps.FIVE_FACTORS), 7
    )


def q_regression_table_wide(spark: SparkSession, sf: str) -> DataFrame:
    fitted = ps.ols_by_group(
        _regression_frame(spark, sf), "return_rf", ps.THREE_FACTORS, "bin"
    )
    return rounded(ps.regression_table_wide(fitted), 7)


# Alphas, coefficients and weights ----------------------------------------------------


def q_alphas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_alphas(spark, sf))


def q_forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_forward(spark, sf))


def q_forward_returns_known(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_forward(spark, sf, percent_units=False, drop_null=True))


def q_information_coefficients(spark: SparkSession, sf: str, method: str) -> DataFrame:
    rets = _forward(spark, sf, drop_null=True, name="fwd_return")
    return rounded(
        ps.information_coefficients(_alphas(spark, sf), rets, method, window=22), 8
    )


def q_mvo_weights(spark: SparkSession, sf: str, *constraints: str) -> DataFrame:
    return rounded(ps.mvo_weights(_alphas(spark, sf), constraints))


def q_mvo_weights_factor_risk(spark: SparkSession, sf: str) -> DataFrame:
    exposures = frame(spark, sf, "fx_exposures").select("date", "barrid", *COMPOSITE)
    # The covariances are in squared percent, the risk here is a decimal.
    covariances = frame(spark, sf, "fx_covariances").withColumn(
        "covariance", F.col("covariance") / 1e4
    )
    return rounded(
        ps.mvo_weights(
            _alphas(spark, sf), risk="factor", exposures=exposures, covariances=covariances
        )
    )


def q_mvo_weights_industry_risk(spark: SparkSession, sf: str) -> DataFrame:
    covariances = load_covariances(spark, frame(spark, sf, "fx_covariances_monthly"))
    return rounded(
        ps.mvo_weights(
            _alphas(spark, sf),
            risk="factor",
            exposures=frame(spark, sf, "fx_industries"),
            covariances=covariances.withColumn("covariance", F.col("covariance") / 1e4),
            as_of=True,
        )
    )


def q_load_covariances(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(load_covariances(spark, frame(spark, sf, "fx_covariances_monthly"), SHORT_START, SHORT_END))


def q_covariance_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ps.covariance_report(frame(spark, sf, "fx_covariances")).drop("least_eigenvalue"))


def q_backtest_by_year(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "backtest")
    return rounded(ps.backtest_by_year(_alphas(spark, sf), path=path, signal="illiq"))


def q_portfolio_returns(spark: SparkSession, sf: str) -> DataFrame:
    weights = ps.mvo_weights(_alphas(spark, sf))
    return rounded(ps.portfolio_returns(weights, _forward(spark, sf)))


def q_portfolio_returns_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    weights = _bucketed(spark, ps.mvo_weights(_alphas(spark, sf)))
    assets = _bucketed(
        spark, load_assets(spark, frame(spark, sf, "fx_assets"), columns=["date", "barrid", "return"])
    )
    with clustered_joins(spark):
        return stage(rounded(ps.portfolio_returns(weights, ps.forward_returns(assets))))


def q_multi_signal_weights(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "weights")
    _store(spark, sf, path)
    return rounded(
        ps.multi_signal_weights(spark, path, SELECTION, SHORT_START, SHORT_END), 11
    )


def q_multi_signal_weights_by_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "weights")
    _store(spark, sf, path)
    # Every signal and gamma that the store holds, less the second gamma of one signal.
    held = read_weights(spark, path).select("signal", "gamma").distinct()
    chosen = stage(held.where("gamma <> 99"))
    return rounded(ps.multi_signal_weights(spark, path, chosen, SHORT_START, SHORT_END), 11)


# Studies -----------------------------------------------------------------------------


def _daily_study(spark: SparkSession, sf: str, **options) -> plans.QuantileStudy:
    return plans.study_daily_quantile(
        spark,
        frame(spark, sf, "fx_market_daily"),
        frame(spark, sf, "fx_factors"),
        START,
        END,
        strict=False,
        **options,
    )


def _exposure_study(spark: SparkSession, sf: str) -> plans.QuantileStudy:
    return plans.study_exposure_quantile(
        spark,
        frame(spark, sf, "fx_assets"),
        frame(spark, sf, "fx_exposures"),
        frame(spark, sf, "fx_factors"),
        START,
        END,
        strict=False,
    )


def _monthly_study(spark: SparkSession, sf: str) -> plans.QuantileStudy:
    market = frame(spark, sf, "fx_market_daily")
    return plans.study_monthly_quantile(spark, market, START, END, min_days=MIN_DAYS)


def q_study_monthly_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_monthly_study(spark, sf).summary, 8)


def q_study_monthly_quantile_curve(spark: SparkSession, sf: str) -> DataFrame:
    study = _monthly_study(spark, sf)
    wide = study.cumulative_wide.withColumnsRenamed({b: f"bin_{b}" for b in study.labels})
    return rounded(wide, 7)


def q_study_daily_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_daily_study(spark, sf).summary, 8)


def q_study_daily_quantile_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_daily_study(spark, sf).regression_table, 7)


def q_study_daily_quantile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_daily_study(spark, sf).stats)


def q_study_daily_quantile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_daily_study(spark, sf).histogram, 8)


def q_study_daily_quantile_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_daily_study(spark, sf).cumulative, 7)


def q_study_daily_quantile_price5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_daily_study(spark, sf, price_filter=5.0).summary, 8)


def q_study_exposure_quantile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_exposure_study(spark, sf).stats)


def q_study_exposure_quantile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_exposure_study(spark, sf).histogram, 8)


def q_study_exposure_quantile_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_exposure_study(spark, sf).cumulative, 7)


def q_study_exposure_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_exposure_study(spark, sf).summary, 8)


def q_study_exposure_quantile_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_exposure_study(spark, sf).regression_table, 7)


def q_study_illiq_backtest(spark: SparkSession, sf: str) -> DataFrame:
    study = plans.study_illiq_backtest(
        spark, frame(spark, sf, "fx_assets"), START, END
    )
    return rounded(study.weights())


def _by_year(extend, spark: SparkSession, sf: str, **options) -> DataFrame:
    """The first years in one run, the last two each from the state that the run before left."""
    assets, path = stage(frame(spark, sf, "fx_assets")), new_path(spark, "extended")
    extend(spark, assets, path, START.year, END.year - 2, fresh=True, **options)
    extend(spark, assets, path, END.year - 1, **options)
    return extend(spark, assets, path, END.year, **options).select("date", "barrid", "weight")


def q_extend_illiq_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_by_year(plans.extend_illiq_backtest, spark, sf))


def q_extend_monthly_illiq_backtest(spark: SparkSession, sf: str) -> DataFrame:
    extended = _by_year(plans.extend_monthly_illiq_backtest, spark, sf, min_days=MIN_DAYS)
    return rounded(extended, 12)


def _monthly_backtest(spark: SparkSession, sf: str) -> plans.BacktestStudy:
    assets = frame(spark, sf, "fx_assets")
    return plans.study_monthly_illiq_backtest(spark, assets, START, END, min_days=MIN_DAYS)


def q_study_monthly_illiq_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_monthly_backtest(spark, sf).weights(), 12)


def q_study_monthly_illiq_backtest_ic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_monthly_backtest(spark, sf).information_coefficients(), 8)


def q_study_monthly_illiq_backtest_ic_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_monthly_backtest(spark, sf).information_coefficients("pearson"), 8)


def _report(spark: SparkSession, sf: str) -> plans.WeightsReport:
    path = new_path(spark, "weights")
    write_weights(ps.mvo_weights(_alphas(spark, sf)), path, "illiq", 50.0)
    return plans.study_mvo_report(
        spark,
        read_weights(spark, path, {"illiq": 50.0}),
        frame(spark, sf, "fx_assets"),
        frame(spark, sf, "fx_factors"),
        START,
        END,
    )


def q_study_mvo_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_report(spark, sf).cumulative, 7)


def q_study_mvo_report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_report(spark, sf).summary, 8)


def q_study_mvo_report_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_report(spark, sf).regression, 7)


def _comparison(spark: SparkSession, sf: str) -> plans.WeightsReport:
    path = new_path(spark, "weights")
    _store(spark, sf, path)
    assets = frame(spark, sf, "fx_assets")
    return plans.study_signal_comparison(spark, path, assets, START, END, SELECTION)


def q_study_signal_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_comparison(spark, sf).summary, 8)


def q_study_signal_comparison_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_comparison(spark, sf).cumulative, 7)


def all_queries() -> dict[str, Query]:
    """Every query by its operator's name."""
    named = {
        name.removeprefix("q_"): query
        for name, query in globals().items()
        if name.startswith("q_")
    }
    coefficients = named.pop("information_coefficients")
    weights = named.pop("mvo_weights")
    both = (ps.ZERO_BETA, ps.ZERO_INVESTMENT)
    return {
        **named,
        "information_coefficients": partial(coefficients, method="rank"),
        "information_coefficients_pearson": partial(coefficients, method="pearson"),
        "mvo_weights": lambda spark, sf: weights(spark, sf, *both),
        "mvo_weights_zero_beta": lambda spark, sf: weights(spark, sf, ps.ZERO_BETA),
        "mvo_weights_zero_investment": lambda spark, sf: weights(
            spark, sf, ps.ZERO_INVESTMENT
        ),
        "mvo_weights_unconstrained": lambda spark, sf: weights(spark, sf),
    }
