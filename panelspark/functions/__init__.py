from panelspark.functions.expressions import illiq_daily, market_cap, month_number, month_of
from panelspark.functions.numeric import (
    full_window,
    ieee_div,
    ieee_log1p,
    is_finite,
    null_cumsum,
    product1,
    safe_corr,
    sum0,
)

__all__ = [
    "full_window",
    "ieee_div",
    "ieee_log1p",
    "illiq_daily",
    "is_finite",
    "market_cap",
    "month_number",
    "month_of",
    "null_cumsum",
    "product1",
    "safe_corr",
    "sum0",
]
