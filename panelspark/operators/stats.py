"""Summary statistics over panels and dated series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.numeric import ieee_div, is_finite
from panelspark.operators import ordering


def signal_stats(
    df: DataFrame, column: str, tiebreak: Sequence[str] | None = None
) -> DataFrame:
    """One row: mean, std, min, q25, q50, q75, max (linear-interpolated quantiles).

    The quantiles are exact over the whole panel, from one range-partitioned sort.
    ``tiebreak`` (default: all other columns) spreads equal values over tasks.
    """
    if tiebreak is None:
        tiebreak = [c for c in df.columns if c != column]
    laid = ordering.lay_out(df.select(column, *tiebreak), [], column, tiebreak)
    return ordering.with_ranks(laid, [], column).agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        ordering.quantile_agg(column, 0.25).alias("q25"),
        ordering.quantile_agg(column, 0.5).alias("q50"),
        ordering.quantile_agg(column, 0.75).alias("q75"),
        F.max(column).alias("max"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width counts over the finite range of ``column``: bin, lo, hi, count.

    The last bin includes its upper edge, empty bins are kept, and a constant column gets a
    unit-wide range around its value. Reads ``df`` twice (range, then counts).
    """
    values = df.where(is_finite(column)).select(F.col(column).alias("_x"))
    same = F.min("_x") == F.max("_x")
    edges = values.agg(
        F.struct(
            F.when(same, F.min("_x") - 0.5).otherwise(F.min("_x")).alias("lo"),
            F.when(same, F.max("_x") + 0.5).otherwise(F.max("_x")).alias("hi"),
        )
    )
    lo, hi = F.col("_edges.lo"), F.col("_edges.hi")
    counts = (
        values.withColumn("_edges", edges.scalar())
        .select(
            F.least(
                F.floor((F.col("_x") - lo) * bins / (hi - lo)), F.lit(bins - 1)
            ).alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    width = (hi - lo) / bins
    return (
        df.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .withColumn("_edges", edges.scalar())
        .join(F.broadcast(counts), "bin", "left")  # at most ``bins`` rows
        .select(
            "bin",
            (lo + width * F.col("bin")).alias("lo"),
            (lo + width * (F.col("bin") + 1)).alias("hi"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column, halves to even."""
    return df.select(
        *[
            F.bround(f"`{f.name}`", digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def performance_summary(
    df: DataFrame, by: str | None = None, periods: int = 252, digits: int | None = None
) -> DataFrame:
    """Annualised mean, volatility and their ratio, per key (descending) or overall."""
    columns = [
        (F.avg("return") * float(periods)).alias("mean_return"),
        (F.stddev_samp("return") * math.sqrt(periods)).alias("volatility"),
    ]
    out = df.groupBy(by).agg(*columns) if by else df.agg(*columns)
    out = out.withColumn("sharpe", ieee_div("mean_return", "volatility"))
    if digits is not None:
        out = round_doubles(out, digits)
    return out.orderBy(F.desc(by)) if by else out


def exposure_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column over rows that have no NULL in any column."""
    complete = df
    for name in df.columns:
        complete = complete.where(F.col(f"`{name}`").isNotNull())
    return complete.select(column).distinct()
