"""Table loaders. ``source`` is a Parquet path or a DataFrame that is already open.

A loader only declares filters and a column list; Catalyst carries both into the Parquet
scan, so a load of three columns over two years reads just that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.sources import contracts

Source = str | DataFrame


def _open(spark: SparkSession, source: Source) -> DataFrame:
    return source if isinstance(source, DataFrame) else spark.read.parquet(source)


def _load(
    spark: SparkSession,
    source: Source,
    contract: T.StructType,
    start: dt.date | None,
    end: dt.date | None,
    columns: Sequence[str] | None,
    in_universe: bool = False,
) -> DataFrame:
    df = _open(spark, source)
    names = list(columns) if columns is not None else list(df.columns)
    contracts.check_contract(df, contract, ["date", *names])
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    if in_universe:
        contracts.check_contract(df, contracts.ASSETS, ["in_universe"])
        df = df.where(F.col("in_universe"))
    return df.select(*[F.col(f"`{name}`") for name in names])


def load_assets(
    spark: SparkSession,
    source: Source,
    start: dt.date | None = None,
    end: dt.date | None = None,
    columns: Sequence[str] | None = None,
    in_universe: bool = True,
) -> DataFrame:
    """Daily asset panel, both dates inclusive, optionally only universe members."""
    return _load(spark, source, contracts.ASSETS, start, end, columns, in_universe)


def load_exposures(
    spark: SparkSession,
    source: Source,
    start: dt.date | None = None,
    end: dt.date | None = None,
    columns: Sequence[str] | None = None,
    in_universe: bool = False,
    universe: Source | None = None,
) -> DataFrame:
    """Wide factor-exposure panel, optionally only universe members.

    Membership is the table's own ``in_universe`` flag, or that of the asset panel given as
    ``universe``, matched on (date, barrid).
    """
    contract = contracts.EXPOSURE_KEYS
    if not in_universe or universe is None:
        return _load(spark, source, contract, start, end, columns, in_universe)
    members = load_assets(spark, universe, start, end, ["date", "barrid"])
    names = list(columns) if columns is not None else _open(spark, source).columns
    keyed = list(dict.fromkeys(["date", "barrid", *names]))
    rows = _load(spark, source, contract, start, end, keyed)
    return rows.join(members, ["date", "barrid"], "left_semi").select(*names)


def load_market_daily(
    spark: SparkSession,
    source: Source,
    start: dt.date | None = None,
    end: dt.date | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Daily market file with decimal returns and possibly negative quotes."""
    return _load(spark, source, contracts.MARKET_DAILY, start, end, columns)


def load_factors(
    spark: SparkSession,
    source: Source,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Factor-return series, one row per date."""
    return _load(spark, source, contracts.FACTORS, start, end, None)


def load_covariances(
    spark: SparkSession,
    source: Source,
    start: dt.date | None = None,
    end: dt.date | None = None,
    factors: Sequence[str] | None = None,
) -> DataFrame:
    """Factor covariances in long form (date, factor_1, factor_2, covariance), both dates inclusive.

    ``factors`` keeps the pairs among these. For the last matrix on or before a date, let
    ``start`` reach back far enough and pass ``as_of=True`` to ``mvo_weights``.
    """
    out = _load(spark, source, contracts.COVARIANCES, start, end, contracts.COVARIANCES.names)
    if factors is not None:
        names = list(factors)
        out = out.where(F.col("factor_1").isin(names) & F.col("factor_2").isin(names))
    return out


def _selected(df: DataFrame, selection: Mapping[str, float] | DataFrame) -> DataFrame:
    """Rows whose (signal, gamma) the selection names, by a join that prunes folders at run time."""
    if isinstance(selection, DataFrame):
        chosen = selection.select("signal", F.col("gamma").cast("double").alias("gamma"))
    else:
        pairs = [(signal, float(gamma)) for signal, gamma in selection.items()]
        # The pairs come from the driver, which bounds what is broadcast.
        chosen = F.broadcast(df.sparkSession.createDataFrame(pairs, "signal string, gamma double"))
    # The optimizer prunes partitions only by a side that has a predicate of its own.
    return df.join(chosen.where(F.col("gamma") > float("-inf")), ["signal", "gamma"], "left_semi")


def read_weights(
    spark: SparkSession,
    path: str,
    signals: Iterable[str] | Mapping[str, float] | DataFrame | None = None,
    gammas: Iterable[float] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Stored weights of the chosen signals and risk aversions.

    ``signal``, ``gamma`` and ``year`` are directories, so the choice and the date range
    prune whole folders before any file is opened. A mapping picks one gamma per signal; a
    frame with columns signal and gamma picks any number of pairs. Both are joined, so the
    plan does not grow with them; a pair named twice or with a NULL adds no row.
    """
    df = spark.read.schema(contracts.WEIGHTS).parquet(path)
    columns = df.columns
    if isinstance(signals, (Mapping, DataFrame)):
        df = _selected(df, signals).select(*columns)
    elif signals is not None:
        df = df.where(F.col("signal").isin(list(signals)))
    if gammas is not None:
        df = df.where(F.col("gamma").isin([float(g) for g in gammas]))
    if start is not None:
        df = df.where((F.col("year") >= start.year) & (F.col("date") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("year") <= end.year) & (F.col("date") <= F.lit(end)))
    return df
