"""Exact ranks and quantiles inside groups of any size.

A window ordered by value inside each date would send a date's whole cross-section to one
task, and the ``percentile`` aggregate would hold all its distinct values in one buffer. Here
rows are range-partitioned by (group, value, tie-break) instead, so one large group, or one
value shared by many rows, spreads over many tasks. The sorted rows are staged with their
position; counting rows per (group, partition) then turns positions into ranks. Only those
counts, at most partitions plus groups many, are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.windows import join_null_safe
from panelspark.sources.staging import stage

RANK = "_rank"
SIZE = "_size"
_SLOT = "_slot"
_PIECE = "_piece"
_PIECE_BITS = 33  # monotonically_increasing_id keeps the partition number above these


def lay_out(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tiebreak: Sequence[str] = (),
    staged: bool = False,
) -> DataFrame:
    """Stage ``df`` sorted by (``by``, ``value``, ``tiebreak``) with each row's position.

    NULL values go last in their group. ``tiebreak`` should make the order total. Range
    partitioning samples its input before it reads it, so ``df`` is staged first and runs
    once; ``staged`` says that it is a scan already.
    """
    if not staged:
        df = stage(df)
    order = [F.col(c) for c in by] + [F.col(value).asc_nulls_last()]
    order += [F.col(c) for c in tiebreak]
    return stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_SLOT, F.monotonically_increasing_id())
    )


def with_ranks(laid: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add the ordinal rank (1-based, NULL for NULL values) and the group's value count."""
    piece = F.shiftright(_SLOT, _PIECE_BITS)
    pieces = laid.groupBy(*by, piece.alias(_PIECE)).agg(
        F.min(_SLOT).alias("_first"), F.count(value).alias("_filled")
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *by,
        _PIECE,
        (F.coalesce(F.sum("_filled").over(earlier), F.lit(0)) - F.col("_first") + 1).alias(
            "_shift"
        ),
        F.sum("_filled").over(group).alias(SIZE),
    )
    if all(isinstance(laid.schema[c].dataType, T.DateType) for c in by):
        # One row per (date, partition it touches): at most partitions + dates.
        offsets = F.broadcast(offsets)
    return (
        join_null_safe(laid.withColumn(_PIECE, piece), offsets, [*by, _PIECE])
        .withColumn(
            RANK, F.when(F.col(value).isNotNull(), F.col(_SLOT) + F.col("_shift"))
        )
        .drop(_PIECE, "_shift")
    )


def quantile_agg(value: str, probability: float) -> Column:
    """Linear-interpolated quantile aggregate over rows that carry rank and group size."""
    spot = F.lit(float(probability)) * (F.col(SIZE) - 1).cast("double")
    zero_based = F.col(RANK) - 1
    low = F.max(F.when(zero_based == F.floor(spot), F.col(value)))
    high = F.max(F.when(zero_based == F.ceil(spot), F.col(value)))
    part = F.max(spot - F.floor(spot))
    return F.when(low == high, low).otherwise(low + (high - low) * part)


def average_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tiebreak: Sequence[str],
    name: str,
) -> DataFrame:
    """Add the rank of ``value`` inside ``by``, equal values sharing their mean rank.

    The tie groups are staged before the join: the optimizer then sees their real size, and
    if they are too many to broadcast, both join sides are plain shuffles that adaptive
    execution may split when one value holds a large share of the rows.
    """
    laid = lay_out(df, by, value, tiebreak)
    ranked = with_ranks(laid, by, value)
    ties = stage(
        ranked.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.min(RANK).alias("_low"), F.max(RANK).alias("_high"))
        .where("_low < _high")
        .select(*by, value, ((F.col("_low") + F.col("_high")) / 2).alias("_shared"))
    )
    return (
        join_null_safe(ranked, ties, [*by, value], "left")
        .withColumn(name, F.coalesce("_shared", F.col(RANK).cast("double")))
        .drop("_shared", RANK, SIZE, _SLOT)
    )


def shared_ranks(pairs: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Ranks inside ``by`` of every column of ``values`` at once, equal values sharing their mean.

    Adds a column ``rank_{value}`` for each; no value may be NULL or NaN. ``pairs`` should be a
    scan. What is sorted is not the rows but how often each (group, value) occurs, counted with
    map-side combine for all columns in one pass, so a value that a third of the rows share is
    one row. The counts are range-partitioned by (column, group, value) and staged; a running
    total inside each piece plus the totals of the pieces before it gives the rank. Only those
    totals, at most pieces plus groups many, are broadcast. The ranks are joined back by
    value, plain shuffles on both sides that adaptive execution splits at a hot value.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("_side"), F.col(v).cast("double").alias("_value")) for i, v in enumerate(values)]))
    counts = (
        pairs.select(by, sides.alias("_one"))
        .select(by, "_one._side", "_one._value")
        .groupBy("_side", by, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = [F.col("_side"), F.col(by), F.col("_value")]
    laid = stage(counts.repartitionByRange(*order).withColumn(_PIECE, F.spark_partition_id()))
    totals = laid.groupBy("_side", by, _PIECE).agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy("_side", by).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_side", by, _PIECE, F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_shift")
    )
    if isinstance(laid.schema[by].dataType, T.DateType):
        # One row per (column, date, piece it touches): at most pieces + dates for each column.
        shifts = F.broadcast(shifts)
    # A piece is bounded by the partition it was, and so is its window.
    inside = Window.partitionBy("_side", by, _PIECE).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = laid.withColumn("_upto", F.sum("_n").over(inside))
    ranked = join_null_safe(summed, shifts, ["_side", by, _PIECE]).select(
        "_side", by, "_value", (F.col("_shift") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank_of")
    )
    out = pairs
    for i, value in enumerate(values):
        one = ranked.where(F.col("_side") == i).select(
            F.col(by).alias("_by"), F.col("_value").alias("_at"), F.col("_rank_of").alias(f"rank_{value}")
        )
        same = out[by].eqNullSafe(one["_by"]) & (out[value].cast("double") == one["_at"])
        out = out.join(one, same).drop("_by", "_at")
    return out
