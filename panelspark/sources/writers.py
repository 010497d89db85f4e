"""Partitioned Parquet sinks for alphas and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, folders: list[str]) -> None:
    # REBALANCE groups rows by output folder to avoid tiny files, and adaptive execution
    # splits a folder that is too large for one task, so one hot year is not one task.
    (
        df.hint("rebalance", *folders)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


def write_alphas(df: DataFrame, path: str, signal: str) -> None:
    """Write alphas under ``signal=…/year=…``; other signals in ``path`` are untouched."""
    tagged = df.withColumns({"signal": F.lit(signal), "year": F.year("date")})
    _write(tagged, path, ["signal", "year"])


def write_weights(df: DataFrame, path: str, signal: str, gamma: float) -> None:
    """Write weights under ``signal=…/gamma=…/year=…``; a rerun replaces only its years."""
    tagged = df.select("date", "barrid", "weight").withColumns(
        {
            "signal": F.lit(signal),
            "gamma": F.lit(float(gamma)),
            "year": F.year("date"),
        }
    )
    _write(tagged, path, ["signal", "gamma", "year"])
