"""Bucketed panels: plans without a shuffle, same rows, and folders that are refused."""

import pytest

import panelspark as ps
from panelspark.catalog.fixtures import frame
from panelspark.sources import LayoutError, clustered_joins, read_panel, stage, write_panel
from tests.conftest import TINY
from tests.test_plan_shapes import plan_of, shuffles


@pytest.fixture(scope="module")
def plain(spark):
    assets = stage(frame(spark, TINY, "fx_assets")).select("date", "barrid", "price", "return")
    return assets, stage(frame(spark, TINY, "fx_exposures"))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("it's a panel"))


@pytest.fixture(scope="module")
def stored(plain, folder):
    return [write_panel(df, f"{folder}/{n}", buckets=6) for n, df in enumerate(plain)]


@pytest.fixture
def no_broadcast(spark):
    """Panels are far too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_composite_signal_on_bucketed_panels_shuffles_nothing(spark, plain, stored, no_broadcast):
    with clustered_joins(spark):
        signal = ps.composite_exposure_signal(*stored, bucketed=True)
        plan = plan_of(signal)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        ours = rows(signal.select("date", "barrid", "illiq"))
    assert ours == rows(ps.composite_exposure_signal(*plain).select("date", "barrid", "illiq"))


def test_returns_on_bucketed_panels_shuffle_only_the_sums(spark, plain, stored, folder, no_broadcast):
    weights = write_panel(plain[0].selectExpr("date", "barrid", "price AS weight"), f"{folder}/w", buckets=6)
    forward = ps.forward_returns(stored[0])
    assert shuffles(forward) == 0
    with clustered_joins(spark):
        out = ps.portfolio_returns(weights, forward)
        assert shuffles(out) == 1 and "partial_sum" in plan_of(out).split("Exchange")[1]
        ours = {r.date: r["return"] for r in out.collect()}
    want = ps.portfolio_returns(plain[0].selectExpr("date", "barrid", "price AS weight"), ps.forward_returns(plain[0]))
    assert ours == pytest.approx({r.date: r["return"] for r in want.collect()})


def test_signals_of_one_panel_shuffle_nothing(spark, stored):
    assert shuffles(ps.vol_scaled_momentum(stored[0])) == 0


def test_a_panel_is_read_again_with_its_layout(spark, plain, stored, folder):
    again = read_panel(spark, f"{folder}/0")
    assert shuffles(ps.forward_returns(again)) == 0
    assert rows(again) == rows(plain[0])


def test_null_keys_and_empty_panels(spark, folder):
    schema = "date date, barrid string, `odd ``name` double"
    df = spark.createDataFrame([(None, None, 1.0), (None, "a", None), (None, "a", None)], schema)
    assert rows(write_panel(df, f"{folder}/null", buckets=3)) == rows(df)
    assert write_panel(df.limit(0), f"{folder}/null", buckets=3).count() == 0


def test_a_folder_without_its_layout_is_refused(spark, plain, folder):
    plain[0].write.parquet(f"{folder}/bare")
    with pytest.raises(LayoutError):
        read_panel(spark, f"{folder}/bare")


def test_the_setting_is_given_back(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    with pytest.raises(RuntimeError), clustered_joins(spark):
        assert spark.conf.get(name) == "false"
        raise RuntimeError
    assert spark.conf.get(name, None) == before
