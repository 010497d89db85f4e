"""Panels stored bucketed by asset, so that later jobs need not shuffle them.

Windows per asset, and joins of panels with the same key and number of buckets, read such a panel
bucket by bucket: the one shuffle is paid when the panel is written. A join on (date, asset) uses
the layout only where the session allows co-partitioning by a part of the join keys; plan it
inside ``clustered_joins``, or set the option for the whole session.

Size ``buckets`` so that one bucket is a comfortable task; panels to be joined need the same count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_LAYOUT = "_layout"


class LayoutError(ValueError):
    """A folder is not a bucketed panel that was written to its end."""


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_panel(
    df: DataFrame, path: str, key: str = "barrid", date: str = "date", buckets: int | None = None
) -> DataFrame:
    """Write ``df`` bucketed by ``key``, one sorted file a bucket, and return the stored panel.

    The default number of buckets is that of the session's shuffle partitions. A panel already
    in ``path`` is replaced. The layout is noted last, so a write that was cut short is no panel.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"panel_{uuid.uuid4().hex}"
    (
        df.repartition(count, key)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(count, key)
        .sortBy(key, date)
        .saveAsTable(name)
    )
    layout = [(key, date, count, df.schema.json())]
    note = spark.createDataFrame(layout, "key string, date string, buckets int, fields string")
    note.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_LAYOUT}")
    spark.sql(f"DROP TABLE {name}")  # its files stay: the table is external
    return read_panel(spark, path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel of ``write_panel`` with its layout, under a new name in the session's catalog."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{_LAYOUT}/_SUCCESS")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        raise LayoutError(f"{path} is not a complete bucketed panel")
    layout = spark.read.parquet(f"{path}/{_LAYOUT}").first()
    fields = T.StructType.fromJson(json.loads(layout["fields"])).fields
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
    key, date = _quoted(layout["key"]), _quoted(layout["date"])
    name = f"panel_{uuid.uuid4().hex}"
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) "
        f"SORTED BY ({key}, {date}) INTO {layout['buckets']} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


@contextmanager
def clustered_joins(spark: SparkSession) -> Iterator[None]:
    """Let joins on several keys use panels clustered by one of them; plan and run inside."""
    before = spark.conf.get(_ALL_KEYS, None)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ALL_KEYS)
        else:
            spark.conf.set(_ALL_KEYS, before)
