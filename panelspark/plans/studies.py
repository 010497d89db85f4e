"""End-to-end studies composed from the operators.

A study is lazy: each result is a cached property, so asking only for the summary does not
pay for the histogram. The filtered panel is the one wide intermediate; it is staged once
with the few columns later steps read, and every branch scans that copy.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.backtest import alphas as make_alphas
from panelspark.operators.backtest import backtest_by_year, multi_signal_weights
from panelspark.operators.crosssection import (
    quantile_bins,
    rank_quantile_bins,
    zscore_by_date,
)
from panelspark.operators.ic import information_coefficients
from panelspark.operators.optimize import ZERO_BETA, ZERO_INVESTMENT
from panelspark.operators.portfolios import (
    bin_returns,
    cumulative_log_return,
    cumulative_wide_ffill,
    portfolio_returns,
    spread_returns,
    vol_target,
)
from panelspark.operators.regression import (
    FIVE_FACTORS,
    THREE_FACTORS,
    lead_factors,
    ols_by_group,
    regression_frame,
    regression_table_wide,
)
from panelspark.operators.signals import (
    composite_exposure_signal,
    exchange_filter,
    forward_returns,
    illiq_monthly_market,
    illiq_monthly_panel,
    illiq_rolling,
    universe_filter,
)
from panelspark.operators.stats import histogram, performance_summary, signal_stats
from panelspark.sources.loaders import (
    Source,
    load_assets,
    load_exposures,
    load_factors,
    load_market_daily,
)
from panelspark.sources.staging import stage

# Study periods and the risk aversion chosen for each stored signal.
IN_SAMPLE = (dt.date(1990, 1, 1), dt.date(2009, 12, 31))
OUT_OF_SAMPLE = (dt.date(2010, 1, 1), dt.date(2024, 12, 31))
FULL_PERIOD = (dt.date(1996, 1, 1), dt.date(2024, 12, 31))
SIGNAL_GAMMAS = {
    "momentum": 50,
    "vol_scaled_momentum": 50,
    "barra_momentum": 50,
    "vol_scaled_barra_momentum": 43,
    "ff3_momentum": 60,
    "vol_scaled_ff3_momentum": 60,
    "ff5_momentum": 60,
    "vol_scaled_ff5_momentum": 60,
    "capm_momentum": 60,
    "vol_scaled_capm_momentum": 60,
}


@dataclass
class QuantileStudy:
    """Sort-into-quantiles study over a filtered panel with date, asset, return and signal.

    ``ranked`` bins ordinal ranks instead of values, ``target`` scales each series to that
    annual volatility, and ``factor_lead`` moves the factors against the returns.
    """

    panel: DataFrame
    key: str
    signal: str
    n_bins: int = 5
    periods: int = 252
    ranked: bool = False
    strict: bool = True
    target: float | None = None
    factors: DataFrame | None = None
    factor_names: Sequence[str] = THREE_FACTORS
    factor_lead: int = 1

    @cached_property
    def filtered(self) -> DataFrame:
        return stage(self.panel)

    @cached_property
    def stats(self) -> DataFrame:
        return signal_stats(self.filtered, self.signal, ("date", self.key))

    @cached_property
    def histogram(self) -> DataFrame:
        return histogram(self.filtered, self.signal)

    @cached_property
    def portfolios(self) -> DataFrame:
        # The sort inside the bin operators stages its own copy, so when nothing else has
        # asked for ``filtered`` yet the panel goes straight into that one.
        panel = self.__dict__.get("filtered", self.panel)
        if self.ranked:
            return rank_quantile_bins(panel, self.signal, self.n_bins, tiebreak=[self.key])
        return quantile_bins(
            panel, self.signal, self.n_bins, strict=self.strict, tiebreak=[self.key]
        )

    @cached_property
    def returns(self) -> DataFrame:
        series = spread_returns(bin_returns(self.portfolios), self.n_bins)
        if self.target is not None:
            series = vol_target(series, self.target, self.periods)
        return stage(series)

    @property
    def labels(self) -> list[str]:
        return [str(k) for k in range(self.n_bins)] + ["spread"]

    @property
    def cumulative(self) -> DataFrame:
        return cumulative_log_return(self.returns)

    @property
    def cumulative_wide(self) -> DataFrame:
        return cumulative_wide_ffill(self.cumulative, self.labels)

    @property
    def summary(self) -> DataFrame:
        return performance_summary(self.returns, "bin", self.periods)

    @property
    def regression(self) -> DataFrame:
        if self.factors is None:
            raise ValueError("this study was built without factors")
        frame = regression_frame(self.returns, lead_factors(self.factors, self.factor_lead))
        return ols_by_group(frame, "return_rf", self.factor_names, "bin")

    @property
    def regression_table(self) -> DataFrame:
        return regression_table_wide(self.regression, "bin", self.factor_names)


def study_monthly_quantile(
    spark: SparkSession,
    market: Source,
    start: dt.date = IN_SAMPLE[0],
    end: dt.date = IN_SAMPLE[1],
    n_bins: int = 5,
    min_days: int = 15,
) -> QuantileStudy:
    """Monthly illiquidity bins by rank; same-month returns, twelve periods a year."""
    columns = ["date", "permno", "ret", "prc", "vol"]
    monthly = illiq_monthly_market(load_market_daily(spark, market, start, end, columns))
    kept = universe_filter(monthly, "permno", "liquidity", min_days_lag=min_days)
    panel = kept.select("date", "permno", F.col("ret").alias("return"), "liquidity")
    return QuantileStudy(panel, "permno", "liquidity", n_bins, periods=12, ranked=True)


def study_daily_quantile(
    spark: SparkSession,
    market: Source,
    factors: Source,
    start: dt.date = IN_SAMPLE[0],
    end: dt.date = IN_SAMPLE[1],
    price_filter: float = 1.0,
    n_bins: int = 5,
    target: float = 0.05,
    strict: bool = True,
    exchanges: Sequence[str] | None = None,
    factor_names: Sequence[str] = THREE_FACTORS,
    factor_lead: int = 1,
    ewm_span: int | None = None,
    vol_window: int | None = None,
) -> QuantileStudy:
    """Daily rolling illiquidity bins, volatility-targeted, with a three-factor fit.

    The factors lead the same-day bin return by one row unless ``factor_lead`` is 0.
    """
    columns = ["date", "permno", "ret", "prc", "vol", "primaryexch"]
    daily = load_market_daily(spark, market, start, end, columns)
    if exchanges is not None:
        daily = exchange_filter(daily, exchanges)
    daily = daily.withColumnsRenamed(
        {"ret": "return", "prc": "price", "vol": "daily_volume"}
    )
    signals = illiq_rolling(daily, "permno", ewm_span=ewm_span, vol_window=vol_window)
    kept = universe_filter(signals, "permno", "illiq", price_filter, finite="no_posinf")
    return QuantileStudy(
        kept.select("date", "permno", "return", "illiq"),
        "permno",
        "illiq",
        n_bins,
        strict=strict,
        target=target,
        factors=load_factors(spark, factors, start, end),
        factor_names=factor_names,
        factor_lead=factor_lead,
    )


def study_exposure_quantile(
    spark: SparkSession,
    assets: Source,
    exposures: Source,
    factors: Source,
    start: dt.date = FULL_PERIOD[0],
    end: dt.date = FULL_PERIOD[1],
    price_filter: float = 5.0,
    n_bins: int = 5,
    target: float = 0.05,
    strict: bool = True,
    cols: Sequence[str] | Mapping[str, float] = (
        "USSLOWL_EARNQLTY",
        "USSLOWL_PROFIT",
        "USSLOWL_VALUE",
    ),
    divisor: float = 4.0,
    factor_names: Sequence[str] = FIVE_FACTORS,
    factor_lead: int = 1,
) -> QuantileStudy:
    """Composite-exposure bins, volatility-targeted, with a five-factor fit."""
    panel = load_assets(spark, assets, start, end, ["date", "barrid", "price", "return"])
    panel = panel.withColumn("return", F.col("return") / 100.0)
    loads = load_exposures(spark, exposures, start, end, ["date", "barrid", *cols])
    signals = composite_exposure_signal(panel, loads, cols, divisor)
    kept = universe_filter(signals, "barrid", "illiq", price_filter, finite="no_posinf")
    return QuantileStudy(
        kept.select("date", "barrid", "return", "illiq"),
        "barrid",
        "illiq",
        n_bins,
        strict=strict,
        target=target,
        factors=load_factors(spark, factors, start, end),
        factor_names=factor_names,
        factor_lead=factor_lead,
    )


@dataclass
class BacktestStudy:
    """Score a filtered signal into alphas, grade them and solve for weights."""

    panel: DataFrame
    signal: str
    assets: DataFrame
    gamma: float
    ic: float = 0.05
    constraints: Iterable[str] = (ZERO_BETA, ZERO_INVESTMENT)
    percent_units: bool = True
    risk: dict = field(default_factory=dict)

    @cached_property
    def alphas(self) -> DataFrame:
        # Scores need the date's moments and then the rows again, and so do the weights, the
        # coefficients and any stored copy: stage the narrow panel they all start from.
        scores = zscore_by_date(stage(self.panel), self.signal)
        return make_alphas(scores, self.ic)

    @cached_property
    def forward_returns(self) -> DataFrame:
        return forward_returns(
            self.assets,
            percent_units=self.percent_units,
            drop_null=True,
            name="fwd_return",
        )

    def information_coefficients(self, method: str = "rank", window: int = 22) -> DataFrame:
        return information_coefficients(self.alphas, self.forward_returns, method, window)

    def weights(self, path: str | None = None) -> DataFrame:
        return backtest_by_year(
            self.alphas, self.constraints, self.gamma, path, self.signal, **self.risk
        )


BACKTEST_COLUMNS = ("date", "barrid", "price", "return", "daily_volume", "specific_risk", "predicted_beta")


def rolling_illiq_panel(data: DataFrame, price_filter: float = 5.0, **options) -> DataFrame:
    """Scoreable rows of the rolling illiquidity; only NULL signals are filtered."""
    kept = universe_filter(
        illiq_rolling(data, "barrid", **options),
        "barrid",
        "illiq",
        price_filter,
        finite="null_only",
        not_null=("predicted_beta", "specific_risk"),
    )
    return kept.select("date", "barrid", "predicted_beta", "specific_risk", "illiq")


def monthly_illiq_panel(data: DataFrame, price_filter: float = 5.0, min_days: int = 15) -> DataFrame:
    """Scoreable rows of the previous month's illiquidity."""
    kept = universe_filter(
        illiq_monthly_panel(data, "barrid"),
        "barrid",
        "liquidity",
        price_filter,
        min_days,
        not_null=("specific_risk", "predicted_beta"),
    )
    return kept.select("date", "barrid", "predicted_beta", "specific_risk", "liquidity")


def decimal_units(data: DataFrame) -> DataFrame:
    """Percent returns and risk as fractions."""
    return data.withColumns({c: F.col(c) / 100.0 for c in ("return", "specific_risk")})


def study_illiq_backtest(
    spark: SparkSession,
    assets: Source,
    start: dt.date = dt.date(1999, 1, 1),
    end: dt.date = dt.date(2001, 12, 31),
    price_filter: float = 5.0,
    gamma: float = 50.0,
    constraints: Iterable[str] = (ZERO_BETA, ZERO_INVESTMENT),
    **risk,
) -> BacktestStudy:
    """Rolling illiquidity scored into alphas.

    Only NULL signals are filtered, so one infinite signal makes its whole date's scores
    non-finite; such rows get no weight.
    """
    data = decimal_units(load_assets(spark, assets, start, end, BACKTEST_COLUMNS))
    return BacktestStudy(
        rolling_illiq_panel(data, price_filter),
        "illiq",
        data,
        gamma,
        constraints=constraints,
        percent_units=False,
        risk=risk,
    )


def study_monthly_illiq_backtest(
    spark: SparkSession,
    assets: Source,
    start: dt.date = FULL_PERIOD[0],
    end: dt.date = FULL_PERIOD[1],
    price_filter: float = 5.0,
    gamma: float = 6000.0,
    min_days: int = 15,
    constraints: Iterable[str] = (ZERO_BETA, ZERO_INVESTMENT),
    percent_units: bool = False,
    **risk,
) -> BacktestStudy:
    """Previous-month illiquidity scored into alphas, with information coefficients.

    Returns and risk stay in percent by default, which is what the large gamma is for;
    ``percent_units`` divides both by 100.
    """
    data = load_assets(spark, assets, start, end, BACKTEST_COLUMNS)
    if percent_units:
        data = decimal_units(data)
    return BacktestStudy(
        monthly_illiq_panel(data, price_filter, min_days),
        "liquidity",
        data,
        gamma,
        constraints=constraints,
        percent_units=False,
        risk=risk,
    )


@dataclass
class WeightsReport:
    """Return series, performance and factor fit of stored weights."""

    weights: DataFrame
    forward: DataFrame
    by: Sequence[str] = ()
    factors: DataFrame | None = None
    factor_lead: int = 1

    @cached_property
    def returns(self) -> DataFrame:
        return stage(portfolio_returns(self.weights, self.forward, ("date", *self.by)))

    @property
    def cumulative(self) -> DataFrame:
        return cumulative_log_return(self.returns, self.by)

    @property
    def summary(self) -> DataFrame:
        return performance_summary(self.returns, self.by[0] if self.by else None)

    @property
    def regression(self) -> DataFrame:
        if self.factors is None:
            raise ValueError("this report was built without factors")
        keys = ("date", *self.by)
        frame = regression_frame(
            self.returns, lead_factors(self.factors, self.factor_lead), keys
        )
        return ols_by_group(
            frame, "return_rf", FIVE_FACTORS, self.by[0] if self.by else None
        )


def _forward(spark: SparkSession, assets: Source, start: dt.date, end: dt.date) -> DataFrame:
    return forward_returns(
        load_assets(spark, assets, start, end, ["date", "barrid", "return"])
    )


def study_mvo_report(
    spark: SparkSession,
    weights: DataFrame,
    assets: Source,
    factors: Source,
    start: dt.date = FULL_PERIOD[0],
    end: dt.date = FULL_PERIOD[1],
) -> WeightsReport:
    """Performance of one signal's weights with a five-factor fit."""
    return WeightsReport(
        weights,
        _forward(spark, assets, start, end),
        factors=load_factors(spark, factors, start, end),
    )


def study_signal_comparison(
    spark: SparkSession,
    path: str,
    assets: Source,
    start: dt.date = FULL_PERIOD[0],
    end: dt.date = FULL_PERIOD[1],
    selection: Mapping[str, float] = SIGNAL_GAMMAS,
) -> WeightsReport:
    """Performance of several stored signals side by side."""
    return WeightsReport(
        multi_signal_weights(spark, path, selection, start, end),
        _forward(spark, assets, start, end),
        by=("signal",),
    )
