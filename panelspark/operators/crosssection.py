"""Per-date cross-sectional operators: quantile bins and standard scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import ieee_div
from panelspark.operators import ordering
from panelspark.operators.windows import join_dated
from panelspark.sources.staging import stage


def _count_true(conditions: Sequence[Column]) -> Column:
    return reduce(add, [c.cast("int") for c in conditions], F.lit(0)).cast("string")


def _other_columns(df: DataFrame, taken: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in taken]


def quantile_bins(
    df: DataFrame,
    col: str,
    n: int,
    by: str = "date",
    strict: bool = True,
    tiebreak: Sequence[str] | None = None,
    name: str = "bin",
) -> DataFrame:
    """Label rows with the quantile interval ``(lo, hi]`` their value falls in, per ``by``.

    Breaks are the linear-interpolated k/n quantiles of the group; labels are "0".."n-1" and
    NULL for a NULL value. ``strict`` raises when two breaks of a group coincide, which any
    one-row group does. Rows with a NULL ``by`` are a group. ``tiebreak`` (default: a hash of
    all other columns) only spreads equal values over tasks; the labels do not depend on it.
    Rows are staged; only group, value and tie-break are sorted.
    """
    rows = stage(df)
    ties = _other_columns(df, [by, col]) if tiebreak is None else list(tiebreak)
    narrow = rows.select(by, col, F.xxhash64(*ties).alias("_tie")) if ties else rows.select(by, col)
    laid = ordering.lay_out(narrow, [by], col, ["_tie"] if ties else [], staged=True)
    names = [f"_q{k}" for k in range(1, n)]
    breaks = (
        ordering.with_ranks(laid, [by], col)
        .groupBy(by)
        .agg(*[ordering.quantile_agg(col, k / n).alias(q) for k, q in enumerate(names, 1)])
    )
    if strict and n > 2:
        same = reduce(or_, [F.col(a) == F.col(b) for a, b in zip(names, names[1:])])
        message = F.concat(F.lit("duplicate quantile breaks at "), F.col(by).cast("string"))
        breaks = breaks.withColumn(
            names[0], F.when(same, F.raise_error(message)).otherwise(F.col(names[0]))
        )
    label = _count_true([F.col(col) > F.col(q) for q in names])
    return (
        join_dated(rows, breaks, date=by)
        .withColumn(name, F.when(F.col(col).isNotNull(), label))
        .select(*df.columns, name)
    )


def rank_quantile_bins(
    df: DataFrame,
    col: str,
    n: int,
    by: str = "date",
    tiebreak: Sequence[str] = ("permno",),
    name: str = "bin",
) -> DataFrame:
    """Label rows by the quantile interval of their ordinal rank, per ``by``.

    Equal values are ranked by ``tiebreak``. Break k of N ranks lies at 1 + (N-1)k/n, so the
    label counts the k with (rank-1)n > (N-1)k, in exact integer arithmetic.
    """
    laid = ordering.lay_out(df, [by], col, tiebreak)
    ranked = ordering.with_ranks(laid, [by], col)
    place = (F.col(ordering.RANK) - 1) * n
    label = _count_true([place > (F.col(ordering.SIZE) - 1) * k for k in range(1, n)])
    return ranked.withColumn(name, F.when(F.col(col).isNotNull(), label)).select(
        *df.columns, name
    )


def zscore_by_date(
    df: DataFrame, col: str, by: str = "date", name: str = "score"
) -> DataFrame:
    """Add ``(x - mean) / std`` of the row's date; a one-row date scores NULL.

    Reads ``df`` twice (moments, then rows): pass a staged frame if it is costly.
    """
    moments = df.groupBy(by).agg(
        F.avg(col).alias("_mean"), F.stddev_samp(col).alias("_std")
    )
    return (
        join_dated(df, moments, date=by)
        .withColumn(name, ieee_div(F.col(col) - F.col("_mean"), "_std"))
        .select(*df.columns, name)
    )
