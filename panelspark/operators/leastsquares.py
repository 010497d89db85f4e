"""Grouped least squares by merged triangles, for factors that nearly depend on each other.

Cross products square the condition number of the factors; a triangle of a QR decomposition does
not. Every task reduces its rows to one small triangle per group, block by block. Triangles of the
same group are stacked and reduced again in two rounds, so no task gathers rows, and a group that
holds most of them is reduced where its rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096
HELD_GROUPS = 4096
HELD_ROWS = 1 << 18
MERGES = 64
# A diagonal entry that lost this share of its column's length is collinear.
_COLLINEAR = 1e-13


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of ``rows``; missing rows count as zeros."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.vstack([rows, np.zeros((width - len(rows), width))])
    if not np.isfinite(rows).all():
        return np.full((width, width), np.nan)
    return np.linalg.qr(rows, mode="r")


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (group, n, triangle) for each group of a task; the group is the first column."""
    held: dict = {}
    kind = None

    def give() -> pa.RecordBatch:
        groups = list(held)
        out = [
            pa.array(groups, kind),
            pa.array([held[g][0] for g in groups], pa.int64()),
            pa.array([_triangle(np.vstack(held[g][1])).ravel() for g in groups], pa.list_(pa.float64())),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(out, ["group", "n", "triangle"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field(0).type
        values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        table = np.column_stack([np.ones(batch.num_rows), *values])
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        for spot, group in enumerate(coded.dictionary.to_pylist()):
            rows = table[order[bounds[spot] : bounds[spot + 1]]]
            n, parts, waiting = held.get(group, (0, [], 0))
            parts, waiting = [*parts, rows], waiting + len(rows)
            if waiting >= BLOCK_ROWS:
                parts, waiting = [_triangle(np.vstack(parts))], 0
            held[group] = (n + len(rows), parts, waiting)
        if len(held) >= HELD_GROUPS or sum(w for _, _, w in held.values()) >= HELD_ROWS:
            yield give()
    if held:
        yield give()


def _stacked(table: pa.Table, width: int) -> tuple[int, np.ndarray]:
    flat = table.column("triangle").combine_chunks().values.to_numpy(zero_copy_only=False)
    return int(np.sum(table.column("n").to_numpy())), _triangle(flat.reshape(-1, width))


def _merge(table: pa.Table, width: int) -> pa.Table:
    n, triangle = _stacked(table, width)
    return pa.table(
        {
            "group": table.column("group").slice(0, 1),
            "n": pa.array([n], pa.int64()),
            "triangle": pa.array([triangle.ravel()], pa.list_(pa.float64())),
        }
    )


def solve_triangle(n: int, triangle: np.ndarray) -> tuple[list, list]:
    """Coefficients and standard errors of the last column on the others; None if undefined."""
    k = len(triangle) - 1
    factors = triangle[:k, :k]
    none = [None] * k
    lengths = np.sqrt((factors**2).sum(axis=0))
    if not np.isfinite(triangle).all() or (np.abs(np.diag(factors)) <= _COLLINEAR * lengths).any():
        return none, none
    inverse = np.linalg.solve(factors, np.eye(k))
    coefficients = np.linalg.solve(factors, triangle[:k, k])
    if n <= k:
        return coefficients.tolist(), none
    noise = triangle[k, k] ** 2 / (n - k)
    return coefficients.tolist(), np.sqrt(noise * (inverse**2).sum(axis=1)).tolist()


def _solve(table: pa.Table, variables: Sequence[str]) -> pa.Table:
    n, triangle = _stacked(table, len(variables) + 1)
    coefficients, errors = solve_triangle(n, triangle)
    group = table.column("group").slice(0, 1).combine_chunks()
    return pa.table(
        {
            "group": group.take(pa.array([0] * len(variables))),
            "variable": pa.array(list(variables), pa.string()),
            "coefficient": pa.array(coefficients, pa.float64()),
            "error": pa.array(errors, pa.float64()),
        }
    )


def triangle_fits(
    clean: DataFrame, y: str, xs: Sequence[str], by: str | None, intercept: str
) -> DataFrame:
    """(``by``, variable, coefficient, _error) of rows without NULL or NaN in a used column."""
    width = len(xs) + 2
    group = F.col(f"`{by}`") if by else F.lit(0)
    rows = clean.select(
        group.alias("group"),
        *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate([*xs, y])],
    )
    kind = rows.schema["group"].dataType
    held = T.StructType(
        [
            T.StructField("group", kind),
            T.StructField("n", T.LongType()),
            T.StructField("triangle", T.ArrayType(T.DoubleType())),
        ]
    )
    fitted = T.StructType(
        [
            T.StructField("group", kind),
            T.StructField("variable", T.StringType()),
            T.StructField("coefficient", T.DoubleType()),
            T.StructField("error", T.DoubleType()),
        ]
    )
    variables = [intercept, *xs]
    fits = (
        rows.mapInArrow(_reduce, held)
        .withColumn("_piece", F.spark_partition_id() % MERGES)
        .groupBy("group", "_piece")
        .applyInArrow(lambda table: _merge(table, width), held)
        .groupBy("group")
        .applyInArrow(lambda table: _solve(table, variables), fitted)
    )
    lead = [F.col("group").alias(by)] if by else []
    return fits.select(*lead, "variable", "coefficient", F.col("error").alias("_error"))
