"""Backtests that go on from an earlier run: a new year reads its own rows and a short state.

Weights are stored as ``backtest_by_year`` stores them. Beside them, below ``_state``, every run
leaves the rows that the next year's signal looks back on (``operators/carry.py``). A run of years
reads the asset rows of these years alone, so its cost does not grow with the history. Weights
are written before the state, whose success mark ends a run: a run that was cut short is repeated,
and any year can be run again from the state of the year before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.carry import illiq_tail, month_tail
from panelspark.operators.optimize import ZERO_BETA, ZERO_INVESTMENT
from panelspark.operators.signals import EWM_STATE
from panelspark.plans.studies import (
    BACKTEST_COLUMNS,
    BacktestStudy,
    decimal_units,
    monthly_illiq_panel,
    rolling_illiq_panel,
)
from panelspark.sources import load_assets, read_state, scope, write_state
from panelspark.sources.loaders import Source


def _state_path(path: str, name: str, year: int) -> str:
    return f"{path}/_state/{name}/as_of={year}"


def _years_with_state(
    spark: SparkSession,
    assets: Source,
    state: str | None,
    first_year: int,
    last_year: int,
    decimals: bool,
    sums: bool = False,
) -> DataFrame:
    """Asset rows of whole years, behind the ``state`` rows of the year before if there are any."""
    if first_year > last_year:
        raise ValueError(f"{first_year} is after {last_year}")
    rows = load_assets(
        spark, assets, dt.date(first_year, 1, 1), dt.date(last_year, 12, 31), BACKTEST_COLUMNS
    )
    if decimals:
        rows = decimal_units(rows)
    if sums:
        kinds = dict.fromkeys(EWM_STATE, "double") | {EWM_STATE[-1]: "bigint"}
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()})
    if state is None:
        return rows
    return read_state(spark, state, rows.schema).unionByName(rows)


def _run(
    study: BacktestStudy, tail: DataFrame, path: str, state: str, first_year: int
) -> DataFrame:
    """Store the weights of the new dates, then the state."""
    study.panel = study.panel.where(F.col("date") >= F.lit(dt.date(first_year, 1, 1)))
    with scope(tail.sparkSession):
        stored = study.weights(path)
        write_state(tail, state)
    return stored


def extend_illiq_backtest(
    spark: SparkSession,
    assets: Source,
    path: str,
    first_year: int,
    last_year: int | None = None,
    fresh: bool = False,
    price_filter: float = 5.0,
    gamma: float = 50.0,
    constraints: Iterable[str] = (ZERO_BETA, ZERO_INVESTMENT),
    window: int = 22,
    lag: int = 2,
    ewm_span: int | None = None,
    vol_window: int | None = None,
    **risk,
) -> DataFrame:
    """Add years to the stored weights of ``study_illiq_backtest``; returns all stored years.

    The first run is ``fresh``; each later one starts in the year after the end of an earlier one.
    The state belongs to the look-back parameters: others find none and raise StateError.
    """
    last_year = first_year if last_year is None else last_year
    look = {"window": window, "lag": lag, "ewm_span": ewm_span, "vol_window": vol_window}
    name = "illiq-" + "-".join(str(v) for v in look.values())
    before = None if fresh else _state_path(path, name, first_year - 1)
    rows = _years_with_state(
        spark, assets, before, first_year, last_year, True, ewm_span is not None
    )
    study = BacktestStudy(
        rolling_illiq_panel(rows, price_filter, **look),
        "illiq",
        rows,
        gamma,
        constraints=constraints,
        percent_units=False,
        risk=risk,
    )
    state = _state_path(path, name, last_year)
    return _run(study, illiq_tail(rows, **look), path, state, first_year)


def extend_monthly_illiq_backtest(
    spark: SparkSession,
    assets: Source,
    path: str,
    first_year: int,
    last_year: int | None = None,
    fresh: bool = False,
    price_filter: float = 5.0,
    gamma: float = 6000.0,
    min_days: int = 15,
    constraints: Iterable[str] = (ZERO_BETA, ZERO_INVESTMENT),
    percent_units: bool = False,
    **risk,
) -> DataFrame:
    """Add years to the stored weights of ``study_monthly_illiq_backtest``, as above."""
    last_year = first_year if last_year is None else last_year
    name = "liquidity-decimal" if percent_units else "liquidity-percent"
    before = None if fresh else _state_path(path, name, first_year - 1)
    rows = _years_with_state(spark, assets, before, first_year, last_year, percent_units)
    study = BacktestStudy(
        monthly_illiq_panel(rows, price_filter, min_days),
        "liquidity",
        rows,
        gamma,
        constraints=constraints,
        percent_units=False,
        risk=risk,
    )
    return _run(study, month_tail(rows), path, _state_path(path, name, last_year), first_year)
