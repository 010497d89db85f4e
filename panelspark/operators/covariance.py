"""Factor covariance matrices: completion, checks and the last matrix known at a date.

A table of matrices is long: date, factor_1, factor_2, covariance, either triangle or both. A
matrix has factors squared many cells, a number that does not grow with the assets, so one row
per matrix with its cells in an array is the form in which they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.contracts import COVARIANCES, ContractError, check_contract


def packed_covariances(covariances: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(date, slots, cells): one row per matrix, its upper triangle as positions and values.

    A position is row * number of factors + column in the order of ``factors``; pairs of other
    factors are left out, absent pairs are 0. A pair given in both orders counts once, with the
    larger value: ``covariance_report`` tells whether they differ.
    """
    k = len(factors)
    known = F.lit(list(factors))
    # Null for a factor that is not among them; one expression, whatever their number.
    one, two = (F.nullif(F.array_position(known, F.col(c)), F.lit(0)).cast("int") - 1 for c in ("factor_1", "factor_2"))
    cells = (
        covariances.select("date", (F.least(one, two) * k + F.greatest(one, two)).alias("slot"), "covariance", (one + two).alias("_both"))
        .where("date IS NOT NULL AND covariance IS NOT NULL AND _both IS NOT NULL")
        .groupBy("date", "slot")
        .agg(F.max("covariance").alias("cell"))
    )
    return cells.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("slot", "cell"))).alias("_all")).select(
        "date", F.col("_all.slot").alias("slots"), F.col("_all.cell").alias("cells")
    )


def as_of_join(days: DataFrame, dated: DataFrame) -> DataFrame:
    """Each row of ``days`` (date) with the row of ``dated`` of the last date on or before it.

    Both frames have at most one row per date. Their dates are merged in one sorted pass in which
    the last known date of ``dated`` is carried forward; only dates go through it, and the wide
    rows of ``dated`` are joined to its result by the date found. Days before the first date of
    ``dated`` are left out.
    """
    known = dated.select("date").withColumn("_found", F.col("date"))
    merged = days.select("date").withColumn("_asked", F.lit(True)).unionByName(known, allowMissingColumns=True)
    one = merged.groupBy("date").agg(F.max("_asked").alias("_asked"), F.max("_found").alias("_found"))
    # The window has no key: it runs over one row per calendar date, which the DATE type bounds.
    carried = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        one.withColumn("_found", F.last("_found", ignorenulls=True).over(carried))
        .where("_asked AND _found IS NOT NULL")
        .select("date", "_found")
    )
    return found.join(dated.withColumnRenamed("date", "_found"), "_found").drop("_found")


def _judged(tolerance: float):
    """Per matrix: missing cells, asymmetry and positive definiteness, a batch of them at a time."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for date, k, rows, cols, mirrored, cells in zip(
                *(frame[c] for c in ("date", "n_factors", "rows", "cols", "mirrored", "cells")), strict=True
            ):
                upper, lower = np.full((k, k), np.nan), np.full((k, k), np.nan)
                for i, j, turned, cell in zip(rows, cols, mirrored, cells, strict=True):
                    (lower if turned else upper)[i, j] = cell
                both = np.where(np.isnan(upper), lower, upper)[np.triu_indices(k)]
                missing = int(np.isnan(both).sum())
                gap = np.nanmax(np.abs(np.nan_to_num(upper - lower, nan=0.0))) if k else 0.0
                full = np.zeros((k, k))
                full[np.triu_indices(k)] = np.nan_to_num(both)
                full = full + np.triu(full, 1).T
                size = float(np.abs(full).max()) if k else 0.0
                least = float(np.linalg.eigvalsh(full)[0]) if np.isfinite(full).all() and k else np.nan
                out.append((date, int(k), missing, float(gap), bool(gap <= tolerance * size), least, bool(least > tolerance * size)))
            yield pd.DataFrame(out, columns=_REPORT_NAMES)

    return judge


_REPORT = (
    "date date, n_factors int, n_missing bigint, asymmetry double, symmetric boolean, "
    "least_eigenvalue double, positive_definite boolean"
)
_REPORT_NAMES = [part.split()[0] for part in _REPORT.split(", ")]


def covariance_report(covariances: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """What is wrong with each matrix, one row per date.

    The factors of a matrix are all names that its date has. n_missing counts pairs given in
    neither order (they are read as 0), asymmetry is the largest difference of a pair given in
    both. ``tolerance`` is relative to the largest cell. NULL covariances count as missing.
    """
    check_contract(covariances, COVARIANCES, COVARIANCES.names)
    names = F.array_sort(F.collect_set("name"))
    listed = (
        covariances.select("date", F.explode(F.array("factor_1", "factor_2")).alias("name"))
        .distinct()
        .groupBy("date")
        .agg(names.alias("_names"))
    )
    pairs = covariances.groupBy("date", "factor_1", "factor_2").agg(F.max("covariance").alias("covariance"))
    at = pairs.join(listed, "date").select(
        "date",
        F.size("_names").alias("n_factors"),
        (F.array_position("_names", F.col("factor_1")) - 1).alias("_i"),
        (F.array_position("_names", F.col("factor_2")) - 1).alias("_j"),
        "covariance",
    )
    given = F.array_sort(
        F.collect_list(
            F.struct(
                F.least("_i", "_j").cast("int").alias("row"),
                F.greatest("_i", "_j").cast("int").alias("col"),
                (F.col("_i") > F.col("_j")).alias("mirrored"),
                F.coalesce("covariance", F.lit(float("nan"))).alias("cell"),
            )
        )
    )
    packed = at.groupBy("date", "n_factors").agg(given.alias("_all"))
    return packed.select(
        "date",
        "n_factors",
        F.col("_all.row").alias("rows"),
        F.col("_all.col").alias("cols"),
        F.col("_all.mirrored").alias("mirrored"),
        F.col("_all.cell").alias("cells"),
    ).mapInPandas(_judged(tolerance), _REPORT)


def check_covariances(covariances: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``covariances`` itself, if every matrix is symmetric and positive definite.

    Otherwise a ContractError names the first date at fault. Runs one job over the matrices.
    """
    bad = covariance_report(covariances, tolerance).where("NOT (symmetric AND positive_definite)")
    first = bad.orderBy("date").first()
    if first is not None:
        fault = "not symmetric" if not first.symmetric else "not positive definite"
        raise ContractError(f"the covariance matrix of {first.date} is {fault}")
    return covariances
