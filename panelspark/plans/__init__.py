from panelspark.plans.incremental import extend_illiq_backtest, extend_monthly_illiq_backtest
from panelspark.plans.studies import (
    FULL_PERIOD,
    IN_SAMPLE,
    OUT_OF_SAMPLE,
    SIGNAL_GAMMAS,
    BacktestStudy,
    QuantileStudy,
    WeightsReport,
    study_daily_quantile,
    study_exposure_quantile,
    study_illiq_backtest,
    study_monthly_illiq_backtest,
    study_monthly_quantile,
    study_mvo_report,
    study_signal_comparison,
)

__all__ = [
    "FULL_PERIOD",
    "IN_SAMPLE",
    "OUT_OF_SAMPLE",
    "SIGNAL_GAMMAS",
    "BacktestStudy",
    "QuantileStudy",
    "WeightsReport",
    "extend_illiq_backtest",
    "extend_monthly_illiq_backtest",
    "study_daily_quantile",
    "study_exposure_quantile",
    "study_illiq_backtest",
    "study_monthly_illiq_backtest",
    "study_monthly_quantile",
    "study_mvo_report",
    "study_signal_comparison",
]
