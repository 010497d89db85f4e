import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import (
    full_window,
    ieee_div,
    ieee_log1p,
    illiq_daily,
    is_finite,
    month_number,
    month_of,
    null_cumsum,
    product1,
    safe_corr,
    sum0,
)

INF, NAN = float("inf"), float("nan")


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def same(got, want):
    if want is None or got is None:
        return got is want
    if math.isnan(want):
        return math.isnan(got)
    return got == want and math.copysign(1, got) == math.copysign(1, want)


@pytest.mark.parametrize(
    "a, b, want",
    [
        (1.0, 0.0, INF),
        (1.0, -0.0, -INF),
        (-1.0, 0.0, -INF),
        (0.0, 0.0, NAN),
        (NAN, 0.0, NAN),
        (None, 0.0, None),
        (1.0, None, None),
        (INF, INF, NAN),
        (3.0, 2.0, 1.5),
        (1.0, INF, 0.0),
    ],
)
def test_ieee_division(spark, a, b, want):
    [(got,)] = one(spark, [(a, b)], "a double, b double", ieee_div("a", "b"))
    assert same(got, want)


@pytest.mark.parametrize(
    "x, want",
    [(-1.0, -INF), (-1.5, NAN), (0.0, 0.0), (INF, INF), (NAN, NAN), (None, None)],
)
def test_ieee_log1p(spark, x, want):
    [(got,)] = one(spark, [(x,)], "x double", ieee_log1p("x"))
    assert same(got, want)


def test_is_finite(spark):
    rows = [(1.0,), (None,), (NAN,), (INF,), (-INF,), (0.0,)]
    assert one(spark, rows, "x double", is_finite("x")) == [
        (True,),
        (False,),
        (False,),
        (False,),
        (False,),
        (True,),
    ]


def test_windows_need_all_values_and_keep_nulls(spark):
    rows = [(1, 1.0), (2, None), (3, 2.0), (4, 4.0), (5, INF), (6, 1.0), (7, 1.0)]
    order = Window.orderBy("i")
    got = one(
        spark,
        rows,
        "i int, x double",
        full_window(F.avg, "x", order, 2),
        null_cumsum("x", order),
    )
    assert [g[0] for g in got] == [None, None, None, 3.0, INF, INF, 1.0]
    assert [g[1] for g in got] == [1.0, None, 3.0, 7.0, INF, INF, INF]


def test_empty_aggregates(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, y double")
    row = df.agg(
        sum0("x").alias("s"), product1("x").alias("p"), safe_corr("x", "y").alias("c")
    ).first()
    assert (row.s, row.p, row.c) == (0.0, 1.0, None)


def test_correlation_of_a_constant_is_null_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(safe_corr("x", "y")).first()[0] is None


def test_correlation_uses_complete_pairs_only(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (100.0, None), (None, -50.0)],
        "x double, y double",
    )
    assert df.agg(safe_corr("x", "y")).first()[0] == pytest.approx(1.0)


def test_expressions(spark):
    got = one(
        spark,
        [("2020-02-29", -0.5, 10.0, -5.0)],
        "d string, r double, v double, p double",
        month_of(F.to_date("d")).cast("string"),
        month_number(F.to_date("d")),
        illiq_daily("r", "v", "p"),
    )
    assert got == [("2020-02-01", 2020 * 12 + 2, -0.01)]
