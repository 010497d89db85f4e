"""Grouped least squares from distributed moments.

One aggregate per group gathers means and centred cross products, and the normal equations
are solved by sweeping that small symmetric matrix in column arithmetic. Every group is
fitted in the same job and no row ever leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import ieee_div
from panelspark.operators.keys import refuse_repeated_dates
from panelspark.operators.leastsquares import triangle_fits
from panelspark.operators.windows import join_dated, series_window

THREE_FACTORS = ("mkt_rf", "smb", "hml")
FIVE_FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")
INTERCEPT = "Intercept"

# A pivot that lost this share of its column's own sum of squares is collinear.
_COLLINEAR = 1e-12


def lead_factors(df: DataFrame, n: int = 1) -> DataFrame:
    """Every factor column moved ``n`` rows earlier; a date that occurs twice fails the job."""
    order = series_window()
    return df.select(
        refuse_repeated_dates().alias("date"),
        *[F.lead(c, n).over(order).alias(c) for c in df.columns if c != "date"],
    )


def regression_frame(
    returns: DataFrame, factors: DataFrame, keys: Sequence[str] = ("date", "bin")
) -> DataFrame:
    """Returns with their date's factors and excess return, all in percent."""
    joined = (
        join_dated(returns, factors, "left", aggregated=False)
        .where(F.col("return").isNotNull())
        .withColumn("return_rf", F.col("return") - F.col("rf"))
    )
    return joined.select(
        *keys,
        *[(F.col(c) * 100.0).alias(c) for c in joined.columns if c not in keys],
    )


def _cell(i: int, j: int) -> str:
    return f"_s{min(i, j)}_{max(i, j)}"


def _cells(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _sweep(df: DataFrame, pivot: int, size: int, kept: Sequence[str]) -> DataFrame:
    """One symmetric sweep; a collinear pivot turns the whole group's result NULL."""
    own = _cell(pivot, pivot)

    def swept(i: int, j: int) -> str:
        if i == pivot and j == pivot:
            return "-1D / _p"
        if pivot in (i, j):
            return f"{_cell(i, j)} / _p"
        return f"{_cell(i, j)} - {_cell(i, pivot)} * {_cell(pivot, j)} / _p"

    return df.selectExpr(
        "*", f"CASE WHEN {own} > _floor{pivot} THEN {own} END AS _p"
    ).selectExpr(*kept, *[f"{swept(i, j)} AS {_cell(i, j)}" for i, j in _cells(size)])


def ols_by_group(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    by: str | None = None,
    method: str = "moments",
) -> DataFrame:
    """Least squares of ``y`` on ``xs`` with an intercept, per group or overall.

    Emits one row per group and variable with its coefficient and t statistic. Rows with a
    NULL or NaN in any used column are left out. Collinear groups get NULLs, as do groups with
    an infinity. ``method`` is ``"moments"`` (one aggregate, for factors that are told apart
    well) or ``"qr"`` (merged triangles, for factors with a condition number up to 1e12).
    """
    if method not in ("moments", "qr"):
        raise ValueError(f"method must be 'moments' or 'qr', not {method!r}")
    used = [f"`{name}`" for name in (*xs, y)]
    k = len(xs)
    groups = [f"`{by}`"] if by else []
    clean = df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in used))
    if method == "qr":
        fits = triangle_fits(clean, y, xs, by, INTERCEPT)
        return fits.withColumn("tstat", ieee_div("coefficient", "_error")).selectExpr(
            *groups, "variable", "coefficient", "tstat"
        )
    moments = ["count(1) AS _n"]
    moments += [f"avg({c}) AS _m{i}" for i, c in enumerate(used)]
    moments += [
        f"covar_samp({used[i]}, {used[j]}) * (count(1) - 1) AS {_cell(i, j)}"
        for i, j in _cells(k + 1)
    ]
    kept = [*groups, "_n"]
    kept += [f"_m{i}" for i in range(k + 1)] + [f"_floor{i}" for i in range(k)]
    grouped = clean.groupBy(by) if by else clean
    solved = (
        grouped.agg(*[F.expr(m) for m in moments])
        .where("_n > 0")
        .selectExpr("*", *[f"{_cell(i, i)} * {_COLLINEAR} AS _floor{i}" for i in range(k)])
    )
    for pivot in range(k):
        solved = _sweep(solved, pivot, k + 1, kept)

    # The swept matrix holds minus the inverse cross products, the coefficients in its last
    # column and the residual sum of squares in its corner.
    fitted = " - ".join([f"_m{k}", *[f"_m{i} * {_cell(i, k)}" for i in range(k)]])
    lever = " - ".join(
        ["1D / _n", *[f"_m{i} * _m{j} * {_cell(i, j)}" for i in range(k) for j in range(k)]]
    )
    rows = [(INTERCEPT, fitted, lever)]
    rows += [(x, _cell(i, k), f"-{_cell(i, i)}") for i, x in enumerate(xs)]
    cells = [
        f"named_struct('variable', '{variable}', 'coefficient', {coefficient}, "
        f"'_scale', {scale})"
        for variable, coefficient, scale in rows
    ]
    residual = _cell(k, k)
    return (
        solved.selectExpr(
            *groups,
            f"CASE WHEN _n > {k + 1} THEN greatest({residual}, 0D) / (_n - {k + 1}) END"
            " AS _noise",
            f"inline(array({', '.join(cells)}))",
        )
        .withColumn("_error", F.sqrt(F.col("_noise") * F.col("_scale")))
        .withColumn("tstat", ieee_div("coefficient", "_error"))
        .selectExpr(*groups, "variable", "coefficient", "tstat")
    )


def regression_table_wide(
    df: DataFrame, by: str = "bin", xs: Sequence[str] = THREE_FACTORS
) -> DataFrame:
    """One row per group with ``coefficient_*`` and ``tstat_*`` columns."""
    variables = [INTERCEPT, *xs]
    wide = (
        df.groupBy(by)
        .pivot("variable", variables)
        .agg(F.first("coefficient").alias("coefficient"), F.first("tstat").alias("tstat"))
    )
    return wide.select(
        by,
        *[
            F.col(f"{v}_{kind}").alias(f"{kind}_{v}")
            for kind in ("coefficient", "tstat")
            for v in variables
        ],
    ).orderBy(by)
