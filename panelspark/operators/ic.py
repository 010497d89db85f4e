"""Information coefficients: how well alphas line up with the next returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import full_window, null_cumsum, safe_corr
from panelspark.operators.ordering import shared_ranks
from panelspark.operators.windows import series_window
from panelspark.sources.staging import stage


def _counts(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def information_coefficients(
    alphas: DataFrame,
    rets: DataFrame,
    method: str = "rank",
    window: int = 22,
    key: str = "barrid",
    ret: str = "fwd_return",
) -> DataFrame:
    """Per-date correlation of alpha and forward return: date, n_assets, ic and two trails.

    ``method="pearson"`` correlates the values, ``"rank"`` their ranks inside the date with
    ties averaged. Pairs with a NULL or NaN side do not count; a constant side gives a NULL ic.
    ``ic_mean`` is the mean over the last ``window`` dates (NULL until all are there) and
    ``ic_cumulative`` the running sum.
    """
    pairs = (
        alphas.select("date", key, "alpha")
        .join(rets.select("date", key, ret), ["date", key])
        .where(_counts("alpha") & _counts(ret))
    )
    left, right = "alpha", ret
    if method == "rank":
        left, right = "rank_alpha", f"rank_{ret}"
        pairs = shared_ranks(stage(pairs.select("date", "alpha", ret)), "date", ["alpha", ret])
    elif method != "pearson":
        raise ValueError(f"method must be 'rank' or 'pearson', not {method!r}")
    daily = pairs.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_assets"), safe_corr(left, right).alias("ic")
    )
    order = series_window()
    return daily.withColumns(
        {
            "ic_mean": full_window(F.avg, "ic", order, window),
            "ic_cumulative": null_cumsum("ic", order),
        }
    )
