"""Alphas, the backtest over all years, and the weights of several signals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.optimize import ZERO_BETA, ZERO_INVESTMENT, mvo_weights
from panelspark.sources.loaders import read_weights
from panelspark.sources.writers import write_weights


def alphas(df: DataFrame, ic: float = 0.05, key: str = "barrid") -> DataFrame:
    """``score * ic * specific_risk``; the risk stays on the row for the optimizer."""
    return df.select(
        "date",
        key,
        (F.col("score") * ic * F.col("specific_risk")).alias("alpha"),
        "predicted_beta",
        "specific_risk",
    )


def backtest_by_year(
    alphas: DataFrame,
    constraints: Iterable[str] = (ZERO_BETA, ZERO_INVESTMENT),
    gamma: float = 50.0,
    path: str | None = None,
    signal: str | None = None,
    **risk,
) -> DataFrame:
    """Weights of every date in one job; with ``path``, stored by signal, gamma and year.

    With ``path`` the stored rows of this signal and gamma are returned, which include
    years kept from earlier runs.
    """
    weights = mvo_weights(alphas, constraints, gamma, **risk)
    if path is None:
        return weights
    if signal is None:
        raise ValueError("storing weights needs a signal name")
    write_weights(weights, path, signal, gamma)
    return read_weights(alphas.sparkSession, path, {signal: gamma})


def multi_signal_weights(
    spark: SparkSession,
    path: str,
    selection: Mapping[str, float] | DataFrame,
    start: dt.date,
    end: dt.date,
) -> DataFrame:
    """Stored weights of several signals: date, asset, weight, signal.

    The selection has one gamma per signal, as a mapping or as a frame (signal, gamma).
    """
    return read_weights(spark, path, selection, start=start, end=end).select(
        "date", "barrid", "weight", "signal"
    )
