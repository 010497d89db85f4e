from panelspark.operators.backtest import alphas, backtest_by_year, multi_signal_weights
from panelspark.operators.carry import illiq_tail, month_tail, tail_rows
from panelspark.operators.covariance import as_of_join, check_covariances, covariance_report
from panelspark.operators.crosssection import quantile_bins, rank_quantile_bins, zscore_by_date
from panelspark.operators.ic import information_coefficients
from panelspark.operators.keys import (
    key_report,
    key_sketches,
    key_violations,
    merge_sketches,
    observe_keys,
    refuse_repeats,
    suspects_repeats,
)
from panelspark.operators.optimize import ZERO_BETA, ZERO_INVESTMENT, mvo_weights
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
    vol_scaled_momentum,
)
from panelspark.operators.stats import (
    exposure_values,
    histogram,
    performance_summary,
    round_doubles,
    signal_stats,
)

__all__ = [
    "FIVE_FACTORS",
    "THREE_FACTORS",
    "ZERO_BETA",
    "ZERO_INVESTMENT",
    "alphas",
    "as_of_join",
    "backtest_by_year",
    "bin_returns",
    "check_covariances",
    "composite_exposure_signal",
    "covariance_report",
    "cumulative_log_return",
    "cumulative_wide_ffill",
    "exchange_filter",
    "exposure_values",
    "forward_returns",
    "histogram",
    "illiq_monthly_market",
    "illiq_monthly_panel",
    "illiq_rolling",
    "illiq_tail",
    "information_coefficients",
    "key_report",
    "key_sketches",
    "key_violations",
    "lead_factors",
    "merge_sketches",
    "month_tail",
    "multi_signal_weights",
    "mvo_weights",
    "observe_keys",
    "ols_by_group",
    "performance_summary",
    "portfolio_returns",
    "quantile_bins",
    "rank_quantile_bins",
    "refuse_repeats",
    "regression_frame",
    "regression_table_wide",
    "round_doubles",
    "signal_stats",
    "spread_returns",
    "suspects_repeats",
    "tail_rows",
    "universe_filter",
    "vol_scaled_momentum",
    "vol_target",
    "zscore_by_date",
]
