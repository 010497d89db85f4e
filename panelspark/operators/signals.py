"""Signal builders: per-asset windows over a (date, asset) panel."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expressions import illiq_daily, month_number, month_of
from panelspark.functions.numeric import (
    full_window,
    ieee_div,
    ieee_log1p,
    is_finite,
    product1,
)
from panelspark.operators.windows import asset_window, long_rolling

# Decay over one block of the exponential mean, as a natural logarithm: 1e-100.
_BLOCK_DECAY = 230.0

# Sums of an exponential mean over an asset's rows before the frame begins, borne by its first row.
EWM_STATE = ("ewm_top", "ewm_bottom", "ewm_odd", "ewm_seen")


def illiq_monthly_market(df: DataFrame, key: str = "permno") -> DataFrame:
    """Monthly mean illiquidity and compounded return; liquidity and day count lag a row.

    Expects date, ``key``, ret, prc, vol. The denominator is the same-day absolute price,
    the day count is all rows of the month, and ``price_lag`` is the lagged absolute price of
    the month's last day. Output is one row per (``key``, month) with the month as ``date``.
    """
    months = asset_window(key)
    return (
        df.select("date", key, "ret", "vol", F.abs("prc").alias("_price"))
        .withColumn("_price_lag", F.lag("_price", 1).over(asset_window(key)))
        .withColumn("_illiq", illiq_daily("ret", "vol", "_price"))
        .groupBy(key, month_of("date").alias("_month"))
        .agg(
            F.avg("_illiq").alias("liquidity"),
            (product1(F.col("ret") + 1.0) - 1.0).alias("ret"),
            F.max_by("_price_lag", "date").alias("price_lag"),
            F.count(F.lit(1)).alias("n_days"),
        )
        .withColumnRenamed("_month", "date")
        .withColumns(
            {
                "liquidity": F.lag("liquidity", 1).over(months),
                "n_days_lag": F.lag("n_days", 1).over(months),
            }
        )
    )


def illiq_monthly_panel(df: DataFrame, key: str = "barrid") -> DataFrame:
    """Daily rows carrying the previous month-row's mean illiquidity and day count.

    Expects date, ``key``, return, price, daily_volume and keeps every other column. The
    denominator uses the lagged price and the count covers non-null daily values. "Previous"
    means the asset's previous month that has rows, whatever the gap.

    Everything is partitioned by asset: the month mean is a window over (asset, month) and
    the previous month is the end of a RANGE frame that stops one month back, so the
    monthly aggregate never has to be joined back to the daily rows.
    """
    in_month = Window.partitionBy(key, "_month_no")
    earlier = (
        Window.partitionBy(key)
        .orderBy("_month_no")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.withColumns(
            {
                "price_lag": F.lag("price", 1).over(asset_window(key)),
                "month": month_of("date"),
                "_month_no": month_number("date"),
            }
        )
        .withColumn("raw_liq", illiq_daily("return", "daily_volume", "price_lag"))
        .withColumns(
            {
                "_mean": F.avg("raw_liq").over(in_month),
                "_days": F.count("raw_liq").over(in_month),
            }
        )
        .withColumns(
            {
                "liquidity": F.last("_mean").over(earlier),
                "n_days_lag": F.last("_days").over(earlier),
            }
        )
        .drop("_mean", "_days", "_month_no")
    )


def ewm_sums(df: DataFrame, value: str, key: str, span: int) -> DataFrame:
    """Add the running sums of an exponential mean: _top, _bottom, _odd and _seen.

    The history is cut into blocks and rows are weighed relative to their block's end, so no
    exponent exceeds a block's decay, ``_BLOCK_DECAY`` in natural logarithms. A row adds the
    running sums of its block to those of the blocks before, decayed; from the fourth block back
    the decay is below the smallest double. Columns ``EWM_STATE``, where present, are the sums
    up to the row before an asset's first one and decay from there.
    """
    window = asset_window(key)
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = math.log((span + 1.0) / (span - 1.0)) if span > 1 else float(_BLOCK_DECAY)
    length = max(1, int(_BLOCK_DECAY / step))
    inside = Window.partitionBy(key, "_block").orderBy("date")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = is_finite(F.col(value))
    df = (
        df.withColumn("_row", F.row_number().over(window) - 1)
        .withColumn("_block", F.floor(F.col("_row") / length))
        .withColumn("_spot", F.col("_row") % length)
        .withColumn("_weight", F.when(usable, F.exp((F.col("_spot") - (length - 1)) * step)))
        .withColumn("_weighted", F.col(value) * F.col("_weight"))
    )

    def total(column: str) -> Column:
        scale = F.exp((F.lit(length - 1) - F.col("_spot")) * step)
        out = F.coalesce(F.sum(column).over(inside), F.lit(0.0)) * scale
        for back in (1, 2, 3):
            block = Window.partitionBy(key).orderBy("_block").rangeBetween(-back, -back)
            decay = F.exp(-(F.col("_spot") + 1 + (back - 1) * length) * step)
            out = out + F.coalesce(F.sum(column).over(block), F.lit(0.0)) * decay
        return out

    sums = {
        "_top": total("_weighted"),
        "_bottom": total("_weight"),
        "_odd": F.sum(F.when(~usable, F.col(value))).over(frame),
        "_seen": F.count(value).over(frame),
    }
    if set(EWM_STATE) <= set(df.columns):
        top, bottom, odd, seen = (F.first(c).over(frame) for c in EWM_STATE)
        decay = F.exp(-(F.col("_row") + 1) * step)
        sums["_top"] = sums["_top"] + F.coalesce(top, F.lit(0.0)) * decay
        sums["_bottom"] = sums["_bottom"] + F.coalesce(bottom, F.lit(0.0)) * decay
        sums["_odd"] = F.coalesce(sums["_odd"] + odd, sums["_odd"], odd)
        sums["_seen"] = sums["_seen"] + F.coalesce(seen, F.lit(0))
    return df.withColumns(sums).drop("_row", "_block", "_spot", "_weight", "_weighted")


def _ewm_mean(df: DataFrame, value: str, key: str, span: int, rows: int) -> DataFrame:
    """Replace ``value`` by its bias-adjusted exponential mean, NULL before ``rows`` values.

    A non-finite value stays in the mean for good.
    """
    return (
        ewm_sums(df, value, key, span)
        .withColumn(
            value,
            F.when(
                F.col(value).isNotNull() & (F.col("_seen") >= rows),
                F.coalesce("_odd", ieee_div(F.col("_top"), "_bottom")),
            ),
        )
        .drop("_top", "_bottom", "_odd", "_seen")
    )


def illiq_rolling(
    df: DataFrame,
    key: str,
    window: int = 22,
    scale: float = 1e7,
    lag: int = 2,
    name: str = "illiq",
    ewm_span: int | None = None,
    vol_window: int | None = None,
) -> DataFrame:
    """``lag(log1p(scale * rolling mean of daily illiquidity))`` per asset.

    Expects date, ``key``, return, price, daily_volume; adds ``name``. ``ewm_span`` swaps the
    rolling mean for an exponential mean that needs as many values as its span, and
    ``vol_window`` divides the mean by the rolling deviation of the return.
    """
    order = asset_window(key)
    daily = df.withColumn("_illiq", illiq_daily("return", "daily_volume", "price"))
    if ewm_span is None:
        mean = daily.withColumn("_illiq", full_window(F.avg, "_illiq", order, window))
    else:
        mean = _ewm_mean(daily, "_illiq", key, ewm_span, ewm_span)
    if vol_window is not None:
        deviation = full_window(F.stddev_samp, "return", order, vol_window)
        mean = mean.withColumn("_vol", deviation).withColumn(
            "_illiq", ieee_div("_illiq", "_vol")
        )
    scaled = ieee_log1p(F.col("_illiq") * scale)
    return (
        mean.withColumn("_scaled", scaled)
        .withColumn(name, F.lag("_scaled", lag).over(order))
        .drop("_illiq", "_scaled", *(["_vol"] if vol_window is not None else []))
    )


def vol_scaled_momentum(
    df: DataFrame,
    key: str = "barrid",
    window: int = 230,
    skip: int = 21,
    name: str = "vol_scaled_momentum",
) -> DataFrame:
    """Rolling log return over rolling volatility, delayed by ``skip`` rows."""
    order = asset_window(key)
    return (
        long_rolling(
            df.withColumn("_log", ieee_log1p("return")),
            key,
            window,
            sums={"_sum": "_log"},
            deviations={"_std": "return"},
        )
        .withColumn("_ratio", ieee_div("_sum", "_std"))
        .withColumn(name, F.lag("_ratio", skip).over(order))
        .drop("_log", "_sum", "_std", "_ratio")
    )


def composite_exposure_signal(
    df: DataFrame,
    exposures: DataFrame,
    cols: Sequence[str] | Mapping[str, float] = (
        "USSLOWL_EARNQLTY",
        "USSLOWL_PROFIT",
        "USSLOWL_VALUE",
    ),
    divisor: float = 4.0,
    lag: int = 2,
    key: str = "barrid",
    name: str = "illiq",
    bucketed: bool = False,
) -> DataFrame:
    """Lagged (weighted) sum of exposures over a fixed divisor, NULL if any part is NULL.

    ``cols`` is a list, or a mapping of column to weight; ``{"X": -1}`` with divisor 1 is a
    reversed exposure. Exposures are left-joined on (date, ``key``). The panel is declared
    partitioned by ``key``: the planner replaces that by its own shuffle where the join needs
    both keys, and where ``spark.sql.requireAllClusterKeysForCoPartition`` is false it serves
    the join and the lag with one shuffle per side. ``bucketed`` says that both panels come
    from ``read_panel``: inside ``clustered_joins`` nothing is shuffled at all.
    """
    parts = [
        F.col(c) * float(cols[c]) if isinstance(cols, Mapping) else F.col(c) for c in cols
    ]
    total: Column = reduce(add, parts)
    return (
        (df if bucketed else df.repartition(key))
        .join(exposures.select("date", key, *cols), ["date", key], "left")
        .withColumn("_composite", total / float(divisor))
        .withColumn(name, F.lag("_composite", lag).over(asset_window(key)))
        .drop("_composite")
    )


def forward_returns(
    df: DataFrame,
    key: str = "barrid",
    percent_units: bool = True,
    drop_null: bool = False,
    name: str = "forward_return",
) -> DataFrame:
    """(date, asset, next row's return); percent returns are divided by 100.

    Rows without a next return stay as NULL unless ``drop_null``.
    """
    ret = F.col("return") / 100.0 if percent_units else F.col("return")
    out = (
        df.select("date", key, ret.alias("_ret"))
        .withColumn(name, F.lead("_ret", 1).over(asset_window(key)))
        .drop("_ret")
    )
    return out.where(F.col(name).isNotNull()) if drop_null else out


def universe_filter(
    df: DataFrame,
    key: str,
    signal: str,
    min_price_lag: float | None = None,
    min_days_lag: int | None = None,
    finite: str = "all",
    not_null: Sequence[str] = (),
    price: str = "price",
) -> DataFrame:
    """Keep tradable rows; each rule is optional because every study uses its own subset.

    ``min_price_lag`` needs the asset's previous row priced strictly above it (an existing
    ``price_lag`` column is used as is), ``min_days_lag`` is a minimum for ``n_days_lag``.
    ``finite`` is ``"all"`` (finite only), ``"no_posinf"`` (NULL, NaN and +inf go, -inf stays)
    or ``"null_only"``.
    """
    x = F.col(signal)
    rules = {
        "all": is_finite(x),
        "no_posinf": x.isNotNull() & ~F.isnan(x) & (x < float("inf")),
        "null_only": x.isNotNull(),
    }
    if finite not in rules:
        raise ValueError(f"finite must be one of {sorted(rules)}, not {finite!r}")
    keep = rules[finite]
    helper = []
    if min_price_lag is not None:
        lagged = "price_lag"
        if lagged not in df.columns:
            lagged = "_price_lag"
            helper = [lagged]
            df = df.withColumn(lagged, F.lag(price, 1).over(asset_window(key)))
        keep = keep & (F.col(lagged) > float(min_price_lag))
    if min_days_lag is not None:
        keep = keep & (F.col("n_days_lag") >= int(min_days_lag))
    for name in not_null:
        keep = keep & F.col(name).isNotNull()
    return df.where(keep).drop(*helper)


def exchange_filter(df: DataFrame, codes: Sequence[str] = ("N", "A")) -> DataFrame:
    """Rows listed on the given primary exchanges."""
    return df.where(F.col("primaryexch").isin(list(codes)))
