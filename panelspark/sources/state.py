"""State that one run leaves for the next: complete folders only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class StateError(ValueError):
    """The state a run has to start from is missing or was not written to its end."""


def write_state(df: DataFrame, path: str) -> None:
    """Replace the state in ``path``."""
    df.write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The state in ``path``; a folder without the committer's success mark is refused."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    files = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(mark):
        raise StateError(f"no complete state in {path}; run the period before it first")
    return spark.read.schema(schema).parquet(path)
