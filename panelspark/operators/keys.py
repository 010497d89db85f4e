"""Key contracts: a panel has one row per (date, asset), a factor series one row per date.

A repeated key doubles weights and moves every lag by a row, silently. Three ways to see it, by
what they cost: counts and a distinct-count sketch observed while a job reads the rows anyway;
a refusal inside the window by asset that signals need anyway; and an exact count by key.
Sketches of parts (years, files) merge, so appended rows are sketched alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, WindowSpec
from pyspark.sql import functions as F

from panelspark.operators.windows import asset_window, series_window

SKETCH_BITS = 14  # a relative standard error of about 0.8 percent
SUSPECT = 1.04  # rows per estimated key from which repeats are certain to five such errors


def _incomplete(keys: Sequence[str]) -> Column:
    some = F.lit(False)
    for key in keys:
        some = some | F.col(key).isNull()
    return some


def _sketch(keys: Sequence[str]) -> Column:
    complete = F.when(~_incomplete(keys), F.xxhash64(*keys))
    return F.hll_sketch_agg(complete, F.lit(SKETCH_BITS))


def _metrics(keys: Sequence[str]) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(_incomplete(keys), 1)).alias("n_null_keys"),
    ]


def observe_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that the next action on it fills, without a pass of its own.

    The observation has n_rows, n_null_keys and n_keys_estimate; see ``suspects_repeats``.
    """
    seen = Observation()
    estimate = F.hll_sketch_estimate(_sketch(keys)).alias("n_keys_estimate")
    return df.observe(seen, *_metrics(keys), estimate), seen


def suspects_repeats(metrics: dict) -> bool:
    """Whether there are more complete rows than the estimated number of keys can explain.

    A few repeats stay below the sketch's error: ``key_report`` is exact.
    """
    return metrics["n_rows"] - metrics["n_null_keys"] > SUSPECT * metrics["n_keys_estimate"]


def key_sketches(df: DataFrame, keys: Sequence[str], part: Column) -> DataFrame:
    """One row per part: part, n_rows, n_null_keys and the sketch of its keys, to be stored."""
    return df.groupBy(part.alias("part")).agg(*_metrics(keys), _sketch(keys).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row over all parts: n_rows, n_null_keys, n_keys_estimate."""
    return sketches.agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null_keys").alias("n_null_keys"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_keys_estimate"),
    )


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows share, and keys with a NULL part: keys, n_rows. Exact."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where((F.col("n_rows") > 1) | _incomplete(keys))


def key_report(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """One row: n_rows, n_keys (complete ones), n_repeated (rows beyond a key's first), n_null_keys.

    Exact, from counts by key that are combined before the shuffle. An empty table gives zeros.
    ``partitions`` is for frames that a plan ends with an aggregate by the same keys, like a panel
    derived in the same job: combining saves nothing there, and both hash tables of the counts
    would lie in one task beside that of the aggregate. Rows are then dealt by key to that many
    tasks, each holding its share of the keys only.
    """
    rows = df.select(*keys)
    if partitions is not None:
        rows = rows.repartition(partitions, *keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    complete = ~_incomplete(keys)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return counts.agg(
        total(F.col("_n")).alias("n_rows"),
        F.count(F.when(complete, 1)).alias("n_keys"),
        total(F.when(complete, F.col("_n") - 1)).alias("n_repeated"),
        total(F.when(~complete, F.col("_n"))).alias("n_null_keys"),
    )


def _refused(window: WindowSpec, date: str, message: Column) -> Column:
    # On the date itself, so that no column pruning can drop the check.
    repeated = (F.row_number().over(window) > 1) & F.lag(date, 1).over(window).eqNullSafe(F.col(date))
    return F.when(repeated, F.raise_error(message)).otherwise(F.col(date))


def refuse_repeats(df: DataFrame, key: str = "barrid", date: str = "date") -> DataFrame:
    """The panel itself; a job that meets a repeated (``date``, ``key``) fails with that key.

    The check is a window by asset in date order and shares the shuffle of the signals after it.
    """
    told = F.concat(
        F.lit(f"repeated ({date}, {key}): "),
        F.coalesce(F.col(date).cast("string"), F.lit("NULL")),
        F.lit(", "),
        F.coalesce(F.col(key).cast("string"), F.lit("NULL")),
    )
    checked = df.withColumn("_checked", _refused(asset_window(key, date), date, told))
    names = [F.col("_checked").alias(date) if c == date else F.col(f"`{c}`") for c in df.columns]
    return checked.select(*names)


def refuse_repeated_dates(date: str = "date") -> Column:
    """The date column of a series with one row per date; a repeated date fails the job."""
    told = F.concat(F.lit(f"repeated {date}: "), F.coalesce(F.col(date).cast("string"), F.lit("NULL")))
    return _refused(series_window(date=date), date, told)
