"""Materialising intermediate frames in the cluster's shared folder.

Several operators read the same intermediate frame more than once. Re-planning it would run
its shuffles again for every reader, so those operators write it once as Parquet under
``spark.checkpoint.dir`` and read it back: lineage is cut, column pruning and filter
pushdown still work on the copy, and a lost executor costs a re-read, not a recompute. The
shuffle files behind a copy are dropped as soon as it is written.

Copies live as long as frames that scan them may: until the ``scope`` they were made in ends,
or until ``release``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the session, or else one in its warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    return context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staging"


def application_folder(spark: SparkSession) -> str:
    """The folder below the root that holds everything this application stages."""
    return f"{staging_root(spark)}/panelspark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, prefix: str = "copy") -> str:
    """A fresh path in the application's folder, owned by the current scope if there is one."""
    path = f"{application_folder(spark)}/{prefix}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once, now, and return a frame that scans the written copy.

    A ``path`` from ``new_path``, taken before a scope, lets the copy outlive that scope.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Own the copies made inside: they are deleted at the end, frames that scan them with them."""
    token = _OWNED.set([])
    try:
        yield
    finally:
        owned = _OWNED.get() or []
        _OWNED.reset(token)
        for path in owned:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every copy this application staged; frames that scan them stop working."""
    _delete(spark, application_folder(spark))
