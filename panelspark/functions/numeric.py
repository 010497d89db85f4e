"""Floating-point helpers that keep IEEE-754 results under Spark's ANSI mode.

Panels contain zero volumes, negative quotes and missing returns, and the downstream
filters distinguish NULL, NaN and infinity. Spark raises on ``x / 0``, returns NULL for
``log1p(-1)`` and returns NULL for empty sums, so every operator goes through this module.
All helpers are plain ``Column`` expressions and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def as_column(value: Column | str | float) -> Column:
    """Names become columns, numbers become literals, columns pass through."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def ieee_div(numerator: Column | str | float, denominator: Column | str | float) -> Column:
    """IEEE division: ``x/±0`` is signed infinity, ``0/0`` is NaN, NULL stays NULL.

    ``pow(±0, -1)`` is the one built-in that yields the signed infinity of a zero
    denominator without raising; ``0 * inf`` then gives NaN by itself.
    """
    a, b = as_column(numerator), as_column(denominator)
    return F.when(b == 0.0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ieee_log1p(value: Column | str) -> Column:
    """``log1p`` with ``-inf`` at -1 and NaN below it, where Spark returns NULL."""
    x = as_column(value)
    return F.when(x == -1.0, F.lit(-INF)).when(x < -1.0, F.lit(NAN)).otherwise(F.log1p(x))


def is_finite(value: Column | str) -> Column:
    """True only for ordinary numbers; NULL, NaN and infinities are False."""
    x = as_column(value)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def full_window(aggregate, value: Column | str, window: WindowSpec, rows: int) -> Column:
    """``aggregate`` over the last ``rows`` rows, NULL unless all of them are non-null."""
    x = as_column(value)
    frame = window.rowsBetween(-(rows - 1), Window.currentRow)
    return F.when(F.count(x).over(frame) >= rows, aggregate(x).over(frame))


def null_cumsum(value: Column | str, window: WindowSpec) -> Column:
    """Running sum that stays NULL on NULL rows instead of repeating the last total."""
    x = as_column(value)
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(x.isNotNull(), F.sum(x).over(frame))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Sample correlation aggregate; a constant side or a single row gives NULL.

    Rows where either side is NULL do not count towards either deviation.
    """
    x, y = as_column(x), as_column(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.try_divide(F.covar_samp(x, y), spread)


def sum0(value: Column | str) -> Column:
    """Sum aggregate that is 0 for an all-null group."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0.0))


def product1(value: Column | str) -> Column:
    """Product aggregate that is 1 for an all-null group."""
    return F.coalesce(F.product(as_column(value)), F.lit(1.0))
