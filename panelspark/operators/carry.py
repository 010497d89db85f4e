"""Carry-over state of a panel: what later rows need of an asset's earlier ones.

A signal looks back a bounded stretch of each asset's history. The last rows of that stretch,
put in front of newer rows, give the newer rows the values a run over the whole history gives
them. State is one short run of rows per asset, whatever the length of the history, and the
state after a run is again the tail of (state, new rows), so assets without new rows keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expressions import illiq_daily, month_number
from panelspark.operators.signals import EWM_STATE, ewm_sums
from panelspark.operators.windows import asset_window


def lookback(
    window: int = 22, lag: int = 2, ewm_span: int | None = None, vol_window: int | None = None
) -> int:
    """Earlier rows that ``illiq_rolling`` and a one-row price lag need before a new row."""
    frames = [window if ewm_span is None else 1, vol_window or 1]
    return max(1, lag + max(frames) - 1)


def tail_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The last ``rows`` rows of each asset by date; each task passes on no more than these."""
    back = Window.partitionBy(key).orderBy(F.desc("date"))
    return df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= rows).drop("_back")


def illiq_tail(
    df: DataFrame,
    key: str = "barrid",
    window: int = 22,
    lag: int = 2,
    ewm_span: int | None = None,
    vol_window: int | None = None,
) -> DataFrame:
    """The rows that ``illiq_rolling`` with these parameters needs before newer ones.

    With ``ewm_span``, each asset's first row bears the sums over all rows before it as the
    columns ``EWM_STATE``; a frame that has such columns already continues them.
    """
    rows = lookback(window, lag, ewm_span, vol_window)
    if ewm_span is None:
        return tail_rows(df, key, rows)
    order = asset_window(key)
    columns = [c for c in df.columns if c not in EWM_STATE]
    carried = [F.col(c) if c in df.columns else F.lit(None) for c in EWM_STATE]
    summed = ewm_sums(
        df.withColumn("_illiq", illiq_daily("return", "daily_volume", "price")),
        "_illiq", key, ewm_span,
    )
    sums = {
        name: F.coalesce(F.lag(now, 1).over(order), before)
        for name, now, before in zip(EWM_STATE, ("_top", "_bottom", "_odd", "_seen"), carried)
    }
    first = (F.col("_back") == rows) | (F.col("_number") == 1)
    return (
        summed.withColumns(
            sums
            | {
                "_back": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date"))),
                "_number": F.row_number().over(order),
            }
        )
        .where(F.col("_back") <= rows)
        .select(*columns, *[F.when(first, F.col(c)).alias(c) for c in EWM_STATE])
    )


def month_tail(df: DataFrame, key: str = "barrid") -> DataFrame:
    """The rows ``illiq_monthly_panel`` needs before those of later months.

    They are an asset's rows in its last month and the one before them, whose price that
    month's first row lags. Later rows have to begin in a later month.
    """
    last = F.max("_month").over(Window.partitionBy(key))
    following = F.lead("_month", 1).over(asset_window(key))
    return (
        df.withColumn("_month", month_number("date"))
        .withColumns({"_last": last, "_following": following})
        .where((F.col("_month") == F.col("_last")) | (F.col("_following") == F.col("_last")))
        .drop("_month", "_last", "_following")
    )
