"""Quantile portfolios and the dated return series made from them.

``bin_returns`` and ``portfolio_returns`` reduce a panel to one row per date and label. The
other operators take such dated frames, which are bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import ieee_div, ieee_log1p, null_cumsum, sum0
from panelspark.operators.windows import series_window


def bin_returns(
    df: DataFrame, ret: str = "return", by: Sequence[str] = ("date", "bin")
) -> DataFrame:
    """Equal-weight mean return per date and bin."""
    return df.groupBy(*by).agg(F.avg(ret).alias("return"))


def spread_returns(df: DataFrame, n: int) -> DataFrame:
    """Complete every date to all ``n`` bins plus "spread", the top minus the bottom bin.

    Bins absent on a date, and a spread with a missing leg, are NULL rows.
    """
    labels = [str(k) for k in range(n)]
    wide = df.groupBy("date").agg(
        *[F.max(F.when(F.col("bin") == b, F.col("return"))).alias(f"_{b}") for b in labels]
    )
    series = [(b, F.col(f"_{b}")) for b in labels]
    series.append(("spread", F.col(f"_{labels[-1]}") - F.col("_0")))
    cells = [F.struct(F.lit(b).alias("bin"), v.alias("return")) for b, v in series]
    return wide.select("date", F.inline(F.array(*cells)))


def vol_target(
    df: DataFrame,
    target: float = 0.05,
    periods: int = 252,
    by: Sequence[str] = ("bin",),
) -> DataFrame:
    """Scale each series to the target annual volatility using its full-sample deviation."""
    deviation = F.stddev_samp("return").over(Window.partitionBy(*by))
    return (
        df.withColumn("_std", deviation)
        .withColumn(
            "return", ieee_div("return", F.col("_std") * (math.sqrt(periods) / target))
        )
        .drop("_std")
    )


def cumulative_log_return(df: DataFrame, series: Sequence[str] = ("bin",)) -> DataFrame:
    """Running percent log return per series; NULL returns stay NULL and add nothing."""
    return (
        df.withColumn("_log", ieee_log1p("return"))
        .withColumn("cumulative_return", null_cumsum("_log", series_window(series)) * 100.0)
        .select("date", *series, "cumulative_return")
    )


def cumulative_wide_ffill(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One column per label, gaps filled with the label's last known value."""
    wide = df.groupBy("date").agg(
        *[
            F.max(F.when(F.col("bin") == b, F.col("cumulative_return"))).alias(b)
            for b in labels
        ]
    )
    so_far = series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return wide.withColumns(
        {b: F.last(F.col(f"`{b}`"), ignorenulls=True).over(so_far) for b in labels}
    )


def portfolio_returns(
    weights: DataFrame,
    rets: DataFrame,
    by: Sequence[str] = ("date",),
    key: str = "barrid",
    ret: str = "forward_return",
) -> DataFrame:
    """Weighted forward return per ``by``; a missing return or weight contributes 0."""
    return (
        weights.join(rets.select("date", key, ret), ["date", key], "left")
        .groupBy(*by)
        .agg(sum0(F.col(ret) * F.col("weight")).alias("return"))
    )
