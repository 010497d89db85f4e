"""Covariance matrices: checks, completion, the last one known, and weights under many factors."""

import numpy as np
import pandas as pd
import pytest

import panelspark as ps
from panelspark.operators.covariance import packed_covariances
from panelspark.operators.optimize import cross_products
from panelspark.sources import ContractError, load_covariances
from tests.conftest import day

LONG = "date date, factor_1 string, factor_2 string, covariance double"
BOTH = (ps.ZERO_BETA, ps.ZERO_INVESTMENT)


def matrix_rows(date, matrix, names, lower=False, both=False):
    k = len(names)
    return [
        (date, names[i], names[j], float(matrix[i, j]))
        for i in range(k)
        for j in range(k)
        if both or (i >= j if lower else i <= j)
    ]


def spread(rng, k):
    root = rng.normal(size=(k, k))
    return root @ root.T / k + np.eye(k)


def test_report_and_check(spark):
    rng, names = np.random.default_rng(1), ["a", "b", "c"]
    good = spread(rng, 3)
    bent = good.copy()
    bent[2, 0] += 0.5
    rows = matrix_rows(day(0), good, names)
    rows += matrix_rows(day(1), good, names, lower=True)
    rows += matrix_rows(day(2), bent, names, both=True)
    rows += matrix_rows(day(3), np.array([[1.0, 2.0, 0.0], [2.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), names)
    rows += [r for r in matrix_rows(day(4), good, names) if r[1:3] != ("a", "c")]
    rows += [(day(5), "a", "a", None)]
    df = spark.createDataFrame(rows, LONG)
    got = {r.date: r for r in ps.covariance_report(df).collect()}
    assert [got[day(i)].symmetric for i in range(6)] == [True, True, False, True, True, True]
    assert [got[day(i)].positive_definite for i in (0, 1, 3, 5)] == [True, True, False, False]
    assert [got[day(i)].n_missing for i in range(6)] == [0, 0, 0, 0, 1, 1]
    assert got[day(2)].asymmetry == pytest.approx(0.5)
    assert got[day(0)].least_eigenvalue == pytest.approx(np.linalg.eigvalsh(good)[0])
    first = df.where("date < '2020-01-03'")
    assert ps.check_covariances(first) is first
    with pytest.raises(ContractError, match="2020-01-03 is not symmetric"):
        ps.check_covariances(df)
    assert ps.covariance_report(df.limit(0)).count() == 0


def test_either_triangle_packs_to_the_same_cells(spark):
    rng, names = np.random.default_rng(2), ["x y", "b`c", "d"]
    m = spread(rng, 3)
    rows = matrix_rows(day(0), m, names) + matrix_rows(day(1), m, names, lower=True) + matrix_rows(day(2), m, names, both=True)
    rows += [(day(0), "other", "d", 9.0)]
    for r in packed_covariances(spark.createDataFrame(rows, LONG), names).collect():
        full = np.zeros(9)
        full[r.slots] = r.cells
        assert np.allclose(full.reshape(3, 3), np.triu(m))


def test_as_of_join(spark):
    known = spark.createDataFrame([(day(3), "a"), (day(7), "b"), (day(90), "c")], "date date, what string")
    days = spark.createDataFrame([(day(i),) for i in (0, 2, 3, 4, 7, 8, 50)], "date date")
    got = {r.date: r.what for r in ps.as_of_join(days, known).collect()}
    assert got == {day(3): "a", day(4): "a", day(7): "b", day(8): "b", day(50): "b"}
    assert ps.as_of_join(days, known.limit(0)).count() == 0


def test_loader_keeps_range_and_factors(spark):
    rows = [(day(i), f, g, 1.0) for i in range(5) for f in "abc" for g in "abc"]
    df = spark.createDataFrame(rows, LONG)
    assert load_covariances(spark, df, day(1), day(2), ["a", "b"]).count() == 8
    with pytest.raises(ContractError):
        load_covariances(spark, df.drop("covariance"))


def test_cross_products_of_a_hot_date_and_any_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(day(0 if i % 3 else i % 11), f"a{i}", [float(x) for x in rng.normal(size=4)], None if i % 17 == 0 else float(rng.random())) for i in range(900)]
    df = spark.createDataFrame(rows, "date date, barrid string, z array<double>, w double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = cross_products(df, "z", "w", "barrid").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for date, part in found.groupby("date"):
        mine = [(r[2], r[3]) for r in rows if r[0] == date and r[3] is not None]
        z, w = np.array([m[0] for m in mine]), np.array([m[1] for m in mine])
        assert part.n.sum() == len(mine)
        assert np.sum(np.stack(part.sums), axis=0) == pytest.approx(((z * w[:, None]).T @ z)[np.triu_indices(4)])


def many(seed, k, dates, assets):
    rng = np.random.default_rng(seed)
    names = [f"f{i}" for i in range(k)]
    rows, loads = [], []
    for d in dates:
        for a in range(assets):
            rows.append((day(d), f"a{a}", float(rng.normal()), float(rng.normal(1, 0.3)), float(rng.uniform(0.1, 0.4))))
            loads.append((day(d), f"a{a}", *(float(x) for x in rng.normal(size=k))))
    return rng, names, rows, loads


def test_seventy_factors_as_of_match_a_full_solve(spark):
    k = 70
    rng, names, rows, loads = many(4, k, (0, 3, 4, 9), 90)
    matrices = {1: spread(rng, k), 4: spread(rng, k)}
    table = [r for d, m in matrices.items() for r in matrix_rows(day(d), m, names, lower=d == 4)]
    exposures = spark.createDataFrame(loads, "date date, barrid string, " + ", ".join(f"{n} double" for n in names))
    got = ps.mvo_weights(
        spark.createDataFrame(rows, "date date, barrid string, alpha double, predicted_beta double, specific_risk double"),
        BOTH, 5.0, risk="factor", exposures=exposures, covariances=spark.createDataFrame(table, LONG), as_of=True,
    ).toPandas()
    assert got[got.date == day(0)].weight.isna().all()
    frame = pd.DataFrame(rows, columns=["date", "barrid", "alpha", "beta", "risk"])
    frame = frame.merge(pd.DataFrame(loads, columns=["date", "barrid", *names]), on=["date", "barrid"]).merge(got, on=["date", "barrid"])
    for d, m in ((3, matrices[1]), (4, matrices[4]), (9, matrices[4])):
        g = frame[frame.date == day(d)]
        x = g[names].to_numpy()
        inverse = np.linalg.inv(x @ m @ x.T + np.diag(g.risk**2))
        c = np.array([np.ones(len(g)), g.beta])
        held = np.linalg.solve(c @ inverse @ c.T, c @ inverse @ g.alpha)
        want = inverse @ (g.alpha - c.T @ held) / 5.0
        assert g.weight.to_numpy() == pytest.approx(np.asarray(want), rel=1e-6, abs=1e-9)


def test_plan_does_not_grow_with_the_square_of_the_factors(spark):
    def length(k):
        _, names, rows, loads = many(1, k, (0,), 3)
        df = ps.mvo_weights(
            spark.createDataFrame(rows, "date date, barrid string, alpha double, predicted_beta double, specific_risk double"),
            risk="factor",
            exposures=spark.createDataFrame(loads, "date date, barrid string, " + ", ".join(f"{n} double" for n in names)),
            covariances=spark.createDataFrame(matrix_rows(day(0), np.eye(k), names), LONG),
        )
        return len(df._jdf.queryExecution().optimizedPlan().toString())

    # The names are listed once; products of them are not.
    assert length(60) < 2 * length(4)
