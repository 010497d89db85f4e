import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

import panelspark as ps
from tests.conftest import day


def sample(seed=7, rows=240, groups=("0", "1", "spread")):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        x = rng.normal(0, 1, 5)
        y = 0.3 + x @ np.array([1.0, -0.5, 0.0, 2.0, 0.1]) + rng.normal(0, 0.7)
        out.append((groups[i % len(groups)], *map(float, x), float(y)))
    return out


SCHEMA = "bin string, mkt_rf double, smb double, hml double, rmw double, cma double, y double"


def lstsq(x, y):
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    left = y - design @ beta
    noise = left @ left / (len(y) - design.shape[1])
    return beta, beta / np.sqrt(noise * np.diag(np.linalg.inv(design.T @ design)))


@pytest.mark.parametrize("names", [ps.THREE_FACTORS, ps.FIVE_FACTORS])
def test_matches_direct_least_squares_per_group(spark, names):
    rows = sample()
    rows += [("0", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("0", math.nan, 1.0, 1.0, 1.0, 1.0, 9.0)]
    out = ps.ols_by_group(spark.createDataFrame(rows, SCHEMA), "y", names, "bin").collect()
    for group in ("0", "1", "spread"):
        data = np.array([r[1:] for r in rows if r[0] == group and r[1] is not None and r[1] == r[1]])
        beta, t = lstsq(data[:, : len(names)], data[:, 5])
        got = {r.variable: r for r in out if r.bin == group}
        for i, name in enumerate(["Intercept", *names]):
            assert got[name].coefficient == pytest.approx(beta[i], rel=1e-9)
            assert got[name].tstat == pytest.approx(t[i], rel=1e-9)


def test_agrees_with_the_library_solver(spark):
    df = spark.createDataFrame(sample(groups=("all",)), SCHEMA)
    ours = {r.variable: r for r in ps.ols_by_group(df, "y", ps.FIVE_FACTORS).collect()}
    features = VectorAssembler(inputCols=list(ps.FIVE_FACTORS), outputCol="f").transform(df)
    fit = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(features)
    for i, name in enumerate(ps.FIVE_FACTORS):
        assert ours[name].coefficient == pytest.approx(fit.coefficients[i], rel=1e-8)
        assert ours[name].tstat == pytest.approx(fit.summary.tValues[i], rel=1e-8)
    assert ours["Intercept"].coefficient == pytest.approx(fit.intercept, rel=1e-8)


def test_degenerate_groups_give_nulls_not_errors(spark):
    rows = [("same", float(i), float(2 * i), 1.0 * (i % 3), 0.0, 0.0, float(i)) for i in range(9)]
    rows += [("few", 1.0, 2.0, 3.0, 0.0, 0.0, 1.0), ("few", 2.0, 1.0, 5.0, 0.0, 0.0, 2.0)]
    out = ps.ols_by_group(spark.createDataFrame(rows, SCHEMA), "y", ps.THREE_FACTORS, "bin")
    got = out.collect()
    assert {r.coefficient for r in got if r.bin == "same"} == {None}
    assert {r.tstat for r in got if r.bin == "few"} == {None}


def test_lead_and_frame(spark):
    names = ["mkt_rf", "smb", "hml", "rmw", "cma", "rf"]
    factors = spark.createDataFrame(
        [(day(i), *[float(i)] * 6) for i in (2, 0, 1)],
        "date date, " + ", ".join(f"{n} double" for n in names),
    )
    led = {r.date: r.rf for r in ps.lead_factors(factors).collect()}
    assert led == {day(0): 1.0, day(1): 2.0, day(2): None}
    returns = spark.createDataFrame(
        [(day(0), "0", 0.5), (day(1), "0", None), (day(9), "0", 0.25)],
        "date date, bin string, return double",
    )
    rows = ps.regression_frame(returns, ps.lead_factors(factors)).orderBy("date").collect()
    assert [r.date for r in rows] == [day(0), day(9)]
    assert (rows[0]["return"], rows[0].mkt_rf, rows[0].return_rf) == (50.0, 100.0, -50.0)
    assert (rows[1]["return"], rows[1].return_rf) == (25.0, None)


def test_wide_table_names(spark):
    out = ps.ols_by_group(spark.createDataFrame(sample(), SCHEMA), "y", ps.THREE_FACTORS, "bin")
    wide = ps.regression_table_wide(out)
    variables = ["Intercept", *ps.THREE_FACTORS]
    assert wide.columns == ["bin"] + [f"{k}_{v}" for k in ("coefficient", "tstat") for v in variables]
    assert [r.bin for r in wide.collect()] == ["0", "1", "spread"]
