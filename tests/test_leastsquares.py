"""Merged triangles against numpy on all rows of a group."""

import datetime as dt

import numpy as np
import pytest

import panelspark as ps
from panelspark.operators import leastsquares


def expected(x, y):
    table = np.column_stack([np.ones(len(x)), x])
    beta, _, _, _ = np.linalg.lstsq(table, y, rcond=None)
    residual = y - table @ beta
    inverse = np.linalg.pinv(table, rcond=1e-15)
    error = np.sqrt(residual @ residual / (len(x) - table.shape[1]) * (inverse**2).sum(axis=1))
    return beta, beta / error


def frame(spark, groups, pieces=7):
    rows = [(name, *map(float, r), float(v)) for name, (x, y) in groups.items() for r, v in zip(x, y)]
    return spark.createDataFrame(rows, "g string, a double, b double, c double, y double").repartition(pieces)


def fits(df, xs=("a", "b", "c"), by="g", **options):
    out = {}
    for r in ps.ols_by_group(df, "y", list(xs), by, method="qr", **options).collect():
        out.setdefault(r[by] if by else None, {})[r.variable] = (r.coefficient, r.tstat)
    return out


def nearly_collinear(rng, n, gap):
    x = rng.normal(size=(n, 3))
    x[:, 1] = x[:, 0] + gap * x[:, 1]
    return x, 1 + x @ [2.0, -1.0, 0.5] + gap * rng.normal(size=n)


def test_ill_conditioned_factors_match_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {name: nearly_collinear(rng, n, 1e-7) for name, n in (("hot", 12000), ("p", 400), ("q", 60))}
    got = fits(frame(spark, groups))
    assert got.keys() == groups.keys()
    for name, (x, y) in groups.items():
        beta, t = expected(x, y)
        ours = [got[name][v] for v in ("Intercept", "a", "b", "c")]
        assert [c for c, _ in ours] == pytest.approx(beta.tolist(), rel=1e-8), name
        assert [s for _, s in ours] == pytest.approx(t.tolist(), rel=1e-6), name
    # Cross products cannot tell these factors apart.
    plain = ps.ols_by_group(frame(spark, {"p": groups["p"]}), "y", ["a", "b", "c"], "g")
    assert all(r.coefficient is None for r in plain.collect())


def test_both_methods_agree_on_ordinary_factors(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, {"p": nearly_collinear(rng, 300, 1.0), "q": nearly_collinear(rng, 50, 1.0)})
    for by in ("g", None):
        got = fits(df, by=by)
        for r in ps.ols_by_group(df, "y", ["a", "b", "c"], by).collect():
            mine = got[r[by] if by else None][r.variable]
            assert mine == (pytest.approx(r.coefficient), pytest.approx(r.tstat))


def test_odd_groups(spark):
    rng = np.random.default_rng(6)
    x, y = nearly_collinear(rng, 40, 1.0)
    same = x.copy()
    same[:, 2] = same[:, 0] * 3 - same[:, 1]
    odd = x.copy()
    odd[5, 0] = np.inf
    groups = {None: (x, y), "same": (same, y), "inf": (odd, y), "few": (x[:3], y[:3]), "exact": (x[:4], y[:4])}
    df = frame(spark, groups)
    gone = spark.createDataFrame([("p", None, 1.0, 1.0, 1.0), ("q", 1.0, 1.0, float("nan"), 1.0)], df.schema)
    got = fits(df.unionByName(gone))
    assert got.keys() == groups.keys()  # groups without a usable row have no fit
    assert got[None]["a"][0] == pytest.approx(expected(x, y)[0][1])
    for name in ("same", "inf", "few"):
        assert set(got[name].values()) == {(None, None)}
    line = np.linalg.solve(np.column_stack([np.ones(4), x[:4]]), y[:4])
    assert got["exact"]["c"] == (pytest.approx(line[3]), None)
    assert fits(df.limit(0)) == {} and fits(df.limit(0), by=None) == {}


def test_few_groups_are_held_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(leastsquares, "HELD_GROUPS", 3)
    monkeypatch.setattr(leastsquares, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(7)
    days = [dt.date(2020, 1, 1 + int(d)) for d in rng.integers(0, 9, 200)]
    x, y = rng.normal(size=200), rng.normal(size=200)
    batch = pa.RecordBatch.from_arrays([pa.array(days), pa.array(x), pa.array(y)], ["group", "_0", "_1"])
    parts = list(leastsquares._reduce(batch.slice(i, 20) for i in range(0, 200, 20)))
    assert len(parts) > 3
    merged = pa.Table.from_batches(parts)
    for d in set(days):
        chosen = merged.filter(pa.compute.equal(merged["group"], pa.scalar(d)))
        n, triangle = leastsquares._stacked(chosen, 3)
        at = [i for i, v in enumerate(days) if v == d]
        beta, _ = expected(x[at][:, None], y[at])
        assert n == len(at) and leastsquares.solve_triangle(n, triangle)[0] == pytest.approx(beta.tolist())


def test_an_unknown_method_is_refused(spark):
    with pytest.raises(ValueError):
        ps.ols_by_group(spark.createDataFrame([(1.0, 1.0)], "a double, y double"), "y", ["a"], method="svd")
