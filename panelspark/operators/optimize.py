"""Constrained mean-variance weights in closed form.

Per date the weights maximise ``alpha'w - gamma/2 w'Sw`` under any of ``sum(w) = 0`` and
``sum(beta w) = 0``. The optimum needs only a handful of cross-sectional sums, so each date is
a small aggregate (combined on the map side, however large the date is) and the weights are a
row expression over the joined-back multipliers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import is_finite
from panelspark.operators.covariance import as_of_join, packed_covariances
from panelspark.operators.windows import join_dated
from panelspark.sources.staging import stage

ZERO_BETA = "ZeroBeta"
ZERO_INVESTMENT = "ZeroInvestment"

# Relative size under which the constraint system counts as degenerate.
_DEGENERATE = 1e-12


def _flags(constraints: Iterable[str]) -> tuple[bool, bool]:
    chosen = set(constraints)
    unknown = chosen - {ZERO_BETA, ZERO_INVESTMENT}
    if unknown:
        raise KeyError(f"unknown constraints: {sorted(unknown)}")
    return ZERO_INVESTMENT in chosen, ZERO_BETA in chosen


def _usable() -> Column:
    return (
        is_finite("alpha")
        & is_finite("predicted_beta")
        & is_finite("specific_risk")
        & (F.col("specific_risk") > 0.0)
    )


def _precision() -> Column:
    return 1.0 / (F.col("specific_risk") * F.col("specific_risk"))


def _multipliers(sums: DataFrame, invest: bool, beta: bool) -> DataFrame:
    """Turn per-date sums a, b, c, p, q, n into the two multipliers; degenerate is NULL."""
    a, b, c, p, q = (F.col(f"_{name}") for name in "abcpq")
    enough = F.col("_n") >= 1 + invest + beta
    if invest and beta:
        det = a * c - b * b
        sound = enough & (det > a * c * _DEGENERATE)
        first, second = F.try_divide(c * p - b * q, det), F.try_divide(a * q - b * p, det)
    elif invest:
        sound, first, second = enough, F.try_divide(p, a), F.lit(0.0)
    elif beta:
        sound, first, second = enough & (c > 0.0), F.lit(0.0), F.try_divide(q, c)
    else:
        sound, first, second = enough, F.lit(0.0), F.lit(0.0)
    return sums.select(
        "date", F.when(sound, first).alias("_l1"), F.when(sound, second).alias("_l2")
    )


def _diagonal(rows: DataFrame, invest: bool, beta: bool, gamma: float) -> DataFrame:
    w, al, be = F.col("_w"), F.col("alpha"), F.col("predicted_beta")
    rows = rows.withColumn("_w", F.when(_usable(), _precision()))
    sums = rows.groupBy("date").agg(
        F.count("_w").alias("_n"),
        F.sum(w).alias("_a"),
        F.sum(w * be).alias("_b"),
        F.sum(w * be * be).alias("_c"),
        F.sum(w * al).alias("_p"),
        F.sum(w * al * be).alias("_q"),
    )
    solved = join_dated(rows, _multipliers(sums, invest, beta))
    return solved.withColumn(
        "weight", (al - F.col("_l1") - F.col("_l2") * be) * w / float(gamma)
    )


# Pieces that one date's cross-section is dealt into, so that a hot date is summed by many tasks.
_PIECES = 16
# What stands before the factor loadings in a row's vector.
_SIDES = ["1D", "predicted_beta", "alpha"]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cross_products(rows: DataFrame, vector: str, weight: str, key: str) -> DataFrame:
    """(date, n, sums): per date and piece of it the weighted cross products of ``vector``.

    ``vector`` is an array column of one length m, never null; rows without a ``weight`` are left
    out. sums is the upper triangle of ``sum(weight * vector' vector)`` row by row, m(m+1)/2
    doubles, so the plan has one expression whatever m is. Rows are dealt by date and a hash of
    ``key``, sorted by date, and summed over Arrow batches one date at a time: a task holds one
    triangle and four megabytes of finished ones, and a date leaves at most 16 of them.
    """

    def accumulate(batches):
        import numpy as np
        import pyarrow as pa

        upper, open_day, count, total = None, None, 0, None
        days, counts, sums = [], [], []

        def done():
            made = [pa.array(days, pa.int32()).cast(pa.date32()), pa.array(counts, pa.int64())]
            flat = np.concatenate(sums)
            ends = np.arange(len(sums) + 1, dtype=np.int32) * (len(flat) // len(sums))
            made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            for held in (days, counts, sums):
                held.clear()
            return pa.RecordBatch.from_arrays(made, ["date", "n", "sums"])

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            scaled = z * batch.column("w").to_numpy(zero_copy_only=False)[:, None]
            dates = batch.column("date").cast(pa.int32()).to_numpy()
            edges = (np.flatnonzero(np.diff(dates)) + 1).tolist()
            if upper is None:
                upper = np.triu_indices(z.shape[1])
            for start, stop in zip([0, *edges], [*edges, rows], strict=True):
                day = int(dates[start])
                if open_day is not None and day != open_day:
                    days.append(open_day)
                    counts.append(count)
                    sums.append(total[upper])
                    count, total = 0, None
                part = scaled[start:stop].T @ z[start:stop]
                open_day, count = day, count + stop - start
                total = part if total is None else total + part
                if len(sums) * len(upper[0]) > 1 << 19:
                    yield done()
        if open_day is not None:
            days.append(open_day)
            counts.append(count)
            sums.append(total[upper])
            yield done()

    piece = F.pmod(F.xxhash64(key), F.lit(_PIECES))
    return (
        rows.where(F.col(weight).isNotNull() & F.col("date").isNotNull())
        .select("date", F.col(vector).alias("z"), F.col(weight).alias("w"), piece.alias("_piece"))
        .repartition("date", "_piece")
        .sortWithinPartitions("date")
        .select("date", "z", "w")
        .mapInArrow(accumulate, "date date, n bigint, sums array<double>")
    )


def _date_solver(k: int, invest: bool, beta: bool):
    """Multipliers and factor pulls per date, from its cross products and its matrix.

    With M = X'D^-1 X and V = X'D^-1 [1, beta, alpha], the low-rank part of the inverse risk
    matrix acts as F (I + M F)^-1 V, which needs no inverse of F. A batch holds dates, one row
    each, and is solved in slices. The returned function is self-contained, so executors need
    numpy and pyarrow but not this package.
    """

    def squares(flat, size):
        """Symmetric matrices from a stack of upper triangles."""
        import numpy as np

        full = np.zeros((len(flat), size, size))
        rows, cols = np.triu_indices(size)
        full[:, rows, cols] = flat
        full[:, cols, rows] = flat
        return full

    def multipliers(counts, full, f):
        import numpy as np

        m, v, plain = full[:, 3:, 3:], full[:, 3:, :3], full[:, :3, :3]
        system = np.eye(k) + m @ f
        try:
            y = f @ np.linalg.solve(system, v)
        except np.linalg.LinAlgError:
            # Only the singular dates go without weights.
            y = np.full(v.shape, np.nan)
            for i in range(len(v)):
                try:
                    y[i] = f[i] @ np.linalg.solve(system[i], v[i])
                except np.linalg.LinAlgError:
                    pass
        inner = plain - v.transpose(0, 2, 1) @ y
        a, b, c = inner[:, 0, 0], inner[:, 0, 1], inner[:, 1, 1]
        p, q = inner[:, 0, 2], inner[:, 1, 2]
        sound = (counts >= 1 + invest + beta) & np.isfinite(y).all(axis=(1, 2))
        l1, l2 = np.zeros(len(v)), np.zeros(len(v))
        with np.errstate(divide="ignore", invalid="ignore"):
            if invest and beta:
                det = a * c - b * b
                sound &= det > a * c * _DEGENERATE
                l1, l2 = (c * p - b * q) / det, (a * q - b * p) / det
            elif invest:
                l1 = p / a
            elif beta:
                sound &= c > 0.0
                l2 = q / c
        return sound, l1, l2, y[:, :, 2] - l1[:, None] * y[:, :, 0] - l2[:, None] * y[:, :, 1]

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        width = (k + 3) * (k + 4) // 2
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                parts = batch.column("parts")
                pieces = parts.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                first = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])[:-1]
                f = np.zeros((batch.num_rows, k * k))
                cells = batch.column("cells")
                owner = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy())
                f[owner, batch.column("slots").flatten().to_numpy()] = cells.flatten().to_numpy(zero_copy_only=False)
                f = f.reshape(-1, k, k)
                f = f + np.triu(f, 1).transpose(0, 2, 1)
                full = squares(np.add.reduceat(pieces, first, axis=0), k + 3)
                sound, l1, l2, pull = multipliers(batch.column("n").to_numpy(), full, f)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("date").filter(pa.array(sound)),
                        pa.array(l1[sound]),
                        pa.array(l2[sound]),
                        pa.array(list(pull[sound]), pa.list_(pa.float64())),
                    ],
                    ["date", "_l1", "_l2", "_pull"],
                )

    return solve


def _factor(
    rows: DataFrame,
    exposures: DataFrame,
    covariances: DataFrame,
    key: str,
    invest: bool,
    beta: bool,
    gamma: float,
    as_of: bool,
) -> DataFrame:
    factors = [c for c in exposures.columns if c not in ("date", key)]
    loads = F.expr(f"array({', '.join(f'CAST({_quoted(c)} AS DOUBLE)' for c in factors)})")
    # One expression over the array, whatever the number of factors.
    known = F.forall("_x", lambda x: F.coalesce(is_finite(x), F.lit(False)))
    # Sums and rows both read the join, so it runs once and is staged.
    rows = stage(
        rows.join(exposures.select("date", key, loads.alias("_x")), ["date", key], "left").withColumn(
            "_w", F.when(_usable() & F.coalesce(known, F.lit(False)), _precision())
        )
    )
    vector = F.concat(F.expr(f"array({', '.join(_SIDES)})"), "_x")
    sums = cross_products(rows.withColumn("_z", vector), "_z", "_w", key)
    risk = packed_covariances(covariances, factors)
    if as_of:
        days = rows.where("_w IS NOT NULL").select("date").distinct()
        risk = as_of_join(days, risk)
    # At most 16 triangles and a matrix per date: neither grows with the assets.
    whole = sums.groupBy("date").agg(F.sum("n").alias("n"), F.collect_list("sums").alias("parts"))
    solved = (
        whole.join(risk, "date")
        .select("date", "n", "parts", "slots", "cells")
        .mapInArrow(
            _date_solver(len(factors), invest, beta), "date date, _l1 double, _l2 double, _pull array<double>"
        )
    )
    pulled = F.aggregate(
        F.zip_with("_x", "_pull", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )
    tilt = (F.col("alpha") - F.col("_l1") - F.col("_l2") * F.col("predicted_beta") - pulled) * F.col("_w")
    return join_dated(rows, solved, "left").withColumn("weight", tilt / float(gamma))


def mvo_weights(
    alphas: DataFrame,
    constraints: Iterable[str] = (ZERO_BETA, ZERO_INVESTMENT),
    gamma: float = 50.0,
    risk: str = "diagonal",
    exposures: DataFrame | None = None,
    covariances: DataFrame | None = None,
    key: str = "barrid",
    as_of: bool = False,
) -> DataFrame:
    """(date, asset, weight) for every row of ``alphas``.

    ``alphas`` has date, ``key``, alpha, predicted_beta, specific_risk. ``risk="diagonal"``
    uses specific variance alone; ``"factor"`` adds exposures times factor covariances
    (``covariances``: date, factor_1, factor_2, covariance; one triangle is enough). With
    ``as_of`` a date takes the last matrix on or before it, else only one of its own day.
    Rows without finite inputs, with factor risk also rows without a finite exposure to each
    factor, get a NULL weight and do not enter the sums, and so do all rows of a date without
    covariances or with singular ones and all rows
    of a date that is too small for its constraints or degenerate. An unknown constraint is
    a KeyError. Reads ``alphas`` twice (sums, then rows).
    """
    invest, beta = _flags(constraints)
    rows = alphas.select("date", key, "alpha", "predicted_beta", "specific_risk")
    if risk == "diagonal":
        out = _diagonal(rows, invest, beta, gamma)
    elif risk == "factor":
        if exposures is None or covariances is None:
            raise ValueError("factor risk needs exposures and covariances")
        out = _factor(rows, exposures, covariances, key, invest, beta, gamma, as_of)
    else:
        raise ValueError(f"risk must be 'diagonal' or 'factor', not {risk!r}")
    return out.select("date", key, "weight")
