"""Column factories: expressions a caller drops into ``select`` or ``withColumns``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.numeric import as_column, ieee_div


def illiq_daily(ret: Column | str, volume: Column | str, price: Column | str) -> Column:
    """Absolute return per unit of traded value."""
    return ieee_div(F.abs(as_column(ret)), as_column(volume) * as_column(price))


def market_cap(shares: Column | str, price: Column | str) -> Column:
    """Shares outstanding times price (sign of the quote is kept)."""
    return as_column(shares) * as_column(price)


def month_of(date: Column | str) -> Column:
    """First day of the month, still a DATE."""
    return F.trunc(as_column(date), "MM").cast("date")


def month_number(date: Column | str) -> Column:
    """Months as a running integer, usable in RANGE frames."""
    d = as_column(date)
    return F.year(d) * 12 + F.month(d)
