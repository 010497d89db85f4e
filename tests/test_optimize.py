import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import panelspark as ps
from tests.conftest import day

SCHEMA = "date date, barrid string, alpha double, predicted_beta double, specific_risk double"
BOTH = (ps.ZERO_BETA, ps.ZERO_INVESTMENT)


def alphas(seed=11, sizes=(6, 9, 40)):
    rng = np.random.default_rng(seed)
    return [
        (day(d), f"a{i:03d}", float(rng.normal(0, 0.02)), float(rng.uniform(0.5, 1.5)), float(rng.uniform(0.1, 0.4)))
        for d, size in enumerate(sizes)
        for i in range(size)
    ]


def full_solve(alpha, beta, risk_matrix, gamma, constraints):
    """Optimality system of the constrained problem, solved densely."""
    rows = []
    if ps.ZERO_INVESTMENT in constraints:
        rows.append(np.ones(len(alpha)))
    if ps.ZERO_BETA in constraints:
        rows.append(beta)
    a = np.array(rows).reshape(len(rows), len(alpha))
    system = np.block(
        [[gamma * risk_matrix, a.T], [a, np.zeros((len(rows), len(rows)))]]
    )
    return np.linalg.solve(system, np.concatenate([alpha, np.zeros(len(rows))]))[: len(alpha)]


@pytest.mark.parametrize("constraints", [BOTH, (ps.ZERO_BETA,), (ps.ZERO_INVESTMENT,), ()])
def test_diagonal_risk_solves_the_full_system(spark, constraints):
    rows = alphas()
    got = ps.mvo_weights(spark.createDataFrame(rows, SCHEMA), constraints, gamma=7.0).toPandas()
    pdf = pd.DataFrame(rows, columns=["date", "barrid", "alpha", "beta", "risk"])
    pdf = pdf.merge(got, on=["date", "barrid"])
    assert len(pdf) == len(rows)
    for _, g in pdf.groupby("date"):
        want = full_solve(g.alpha, g.beta, np.diag(g.risk**2), 7.0, constraints)
        assert g.weight.to_numpy() == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_factor_risk_solves_the_full_system(spark):
    rng = np.random.default_rng(4)
    rows = alphas()
    names = ["f0", "f1", "f2", "f3"]
    loads = [(r[0], r[1], *map(float, rng.normal(size=4))) for r in rows if r[1] != "a002"]
    cov = {}
    table = []
    for d in range(3):
        half = rng.normal(size=(4, 4)) * 0.1
        cov[day(d)] = half @ half.T + 0.01 * np.eye(4)
        table += [
            (day(d), names[i], names[j], float(cov[day(d)][i, j])) for i in range(4) for j in range(i, 4)
        ]
    exposures = spark.createDataFrame(
        loads, "date date, barrid string, " + ", ".join(f"{n} double" for n in names)
    )
    covariances = spark.createDataFrame(
        table, "date date, factor_1 string, factor_2 string, covariance double"
    )
    for constraints in (BOTH, (ps.ZERO_BETA,), (ps.ZERO_INVESTMENT,), ()):
        got = ps.mvo_weights(
            spark.createDataFrame(rows, SCHEMA),
            constraints,
            5.0,
            risk="factor",
            exposures=exposures,
            covariances=covariances,
        ).toPandas()
        pdf = pd.DataFrame(rows, columns=["date", "barrid", "alpha", "beta", "risk"])
        known = pd.DataFrame(loads, columns=["date", "barrid", *names])
        assert got[got.barrid == "a002"].weight.isna().all()
        pdf = pdf.merge(known, on=["date", "barrid"])
        pdf = pdf.merge(got, on=["date", "barrid"])
        for date, g in pdf.groupby("date"):
            x = g[names].to_numpy()
            matrix = x @ cov[date] @ x.T + np.diag(g.risk**2)
            want = full_solve(g.alpha, g.beta, matrix, 5.0, constraints)
            assert g.weight.to_numpy() == pytest.approx(want, rel=1e-7, abs=1e-10)


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.integers(0, 10_000))
def test_weights_are_feasible_and_beat_feasible_neighbours(spark, seed):
    rows = alphas(seed, (12,))
    got = ps.mvo_weights(spark.createDataFrame(rows, SCHEMA), BOTH, 3.0).toPandas()
    got = got.sort_values("barrid")
    alpha, beta, risk = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    w = got.weight.to_numpy()
    assert abs(w.sum()) < 1e-9 and abs(w @ beta) < 1e-9

    def value(v):
        return alpha @ v - 1.5 * (v * v) @ (risk * risk)

    span = np.linalg.svd(np.array([np.ones(12), beta]))[2][2:]
    for step in np.random.default_rng(seed).normal(size=(20, 10)):
        assert value(w) >= value(w + 0.01 * step @ span) - 1e-12


def test_unusable_rows_and_small_dates_get_no_weight(spark):
    rows = alphas(sizes=(2, 5))
    rows[3] = (*rows[3][:2], None, *rows[3][3:])
    rows[4] = (*rows[4][:4], 0.0)
    got = {r.barrid + str(r.date.day): r.weight for r in ps.mvo_weights(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in ("a0001", "a0011")] == [None, None]
    assert got["a0012"] is None and got["a0022"] is None
    assert abs(sum(got[k] for k in ("a0002", "a0032", "a0042"))) < 1e-12


def test_equal_betas_are_degenerate(spark):
    rows = [(*r[:3], 1.0, r[4]) for r in alphas(sizes=(5,))]
    got = ps.mvo_weights(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.weight for r in got} == {None}


def test_unknown_names(spark):
    df = spark.createDataFrame(alphas(sizes=(3,)), SCHEMA)
    with pytest.raises(KeyError):
        ps.mvo_weights(df, ("LongOnly",))
    with pytest.raises(ValueError):
        ps.mvo_weights(df, risk="full")
    with pytest.raises(ValueError):
        ps.mvo_weights(df, risk="factor")


@pytest.mark.parametrize("method", ["rank", "pearson"])
def test_information_coefficients_match_pandas(spark, method):
    rng = np.random.default_rng(9)
    rows = [
        (day(d), f"a{i}", float(rng.integers(0, 8)), float(rng.integers(-3, 4)))
        for d in range(30)
        for i in range(15)
        if rng.random() < 0.9
    ]
    rows += [(day(40), "solo", 1.0, 1.0), (day(41), "a", 1.0, 2.0), (day(41), "b", 1.0, 3.0)]
    pdf = pd.DataFrame(rows, columns=["date", "barrid", "alpha", "fwd_return"])
    df = spark.createDataFrame(pdf, "date date, barrid string, alpha double, fwd_return double")
    got = ps.information_coefficients(
        df.select("date", "barrid", "alpha"),
        df.select("date", "barrid", "fwd_return"),
        method,
        window=5,
    ).toPandas()
    got = got.sort_values("date").reset_index(drop=True)
    kind = "spearman" if method == "rank" else "pearson"
    ranked = pdf.copy()
    if kind == "spearman":
        for c in ("alpha", "fwd_return"):
            ranked[c] = pdf.groupby("date")[c].rank()
    want = ranked.groupby("date").apply(
        lambda g: g.alpha.corr(g.fwd_return) if g.alpha.std() else np.nan, include_groups=False
    )
    assert got.ic.to_numpy(float) == pytest.approx(want.to_numpy(float), nan_ok=True, rel=1e-9)
    assert got.ic_mean[10] == pytest.approx(got.ic[6:11].mean())
    assert np.isnan(got.ic_mean[3])
    assert got.ic_cumulative[29] == pytest.approx(got.ic[:30].sum())
    assert got.n_assets[30] == 1
