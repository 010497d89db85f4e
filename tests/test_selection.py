"""Stored weights chosen by a joined table of signals and gammas."""

import pytest

import panelspark as ps
from panelspark.sources import read_weights, stage, write_weights
from tests.conftest import day
from tests.test_plan_shapes import plan_of


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("weights"))
    rows = [(day(i), f"a{j}", float(i - j)) for i in range(5) for j in range(4)]
    df = stage(spark.createDataFrame(rows, "date date, barrid string, weight double"))
    for signal, gamma in (("s", 50.0), ("s", 99.0), ("t", 50.0), ("u", 7.5)):
        write_weights(df.selectExpr("date", "barrid", f"weight * {gamma} AS weight"), path, signal, gamma)
    return path


def pairs(df):
    return {(r.signal, r.gamma): r["count"] for r in df.groupBy("signal", "gamma").count().collect()}


def test_the_choice_is_a_dynamic_filter_on_folders(spark, store):
    df = read_weights(spark, store, {"s": 50, "u": 7.5})
    scan = next(line for line in plan_of(df).splitlines() if "PartitionFilters" in line)
    assert scan.count("dynamicpruning") >= 2, scan
    assert df.columns == read_weights(spark, store).columns
    assert pairs(df) == {("s", 50.0): 20, ("u", 7.5): 20}


def test_a_thousand_pairs_keep_the_plan_small(spark, store):
    many = {f"x{i}": float(i) for i in range(1000)} | {"t": 50}
    assert pairs(read_weights(spark, store, many)) == {("t", 50.0): 20}
    few = plan_of(read_weights(spark, store, {"t": 50}))
    assert len(plan_of(read_weights(spark, store, many))) < 2 * len(few)


def test_a_table_picks_several_gammas_and_repeats_change_nothing(spark, store):
    rows = [("s", 50.0), ("s", 99.0), ("s", 99.0), (None, 50.0), ("t", None), ("gone", 1.0)]
    chosen = spark.createDataFrame(rows, "signal string, gamma double")
    assert pairs(read_weights(spark, store, chosen)) == {("s", 50.0): 20, ("s", 99.0): 20}
    got = ps.multi_signal_weights(spark, store, chosen, day(1), day(2))
    assert got.columns == ["date", "barrid", "weight", "signal"] and got.count() == 16
    assert read_weights(spark, store, chosen.limit(0)).count() == 0
    assert read_weights(spark, store, {}).count() == 0
