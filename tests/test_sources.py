import datetime as dt

import pytest
from pyspark.sql import functions as F

import panelspark as ps
from panelspark import plans
from panelspark.catalog.fixtures import frame
from panelspark.sources import (
    ContractError,
    load_assets,
    load_exposures,
    load_factors,
    read_weights,
    stage,
    staging_root,
    write_alphas,
    write_weights,
)
from panelspark.sources import staging
from tests.conftest import TINY

START, END = dt.date(1995, 1, 1), dt.date(1996, 6, 30)


@pytest.fixture(scope="module")
def assets_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "assets")
    frame(spark, TINY, "fx_assets").write.parquet(path)
    return path


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_loader_filters_reach_the_scan(spark, assets_path):
    df = load_assets(spark, assets_path, START, END, ["date", "barrid", "price"])
    plan = executed(df)
    assert "GreaterThanOrEqual(date,1995-01-01)" in plan
    assert "LessThanOrEqual(date,1996-06-30)" in plan
    assert "in_universe" in plan.split("PushedFilters")[1]
    assert "specific_risk" not in plan
    bounds = df.agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert START <= bounds[0] and bounds[1] <= END and bounds[2] > 0


def test_universe_flag_is_optional(spark, assets_path):
    inside = load_assets(spark, assets_path, columns=["date", "barrid"])
    everything = load_assets(spark, assets_path, columns=["date", "barrid"], in_universe=False)
    assert inside.count() <= everything.count()


def test_contracts(spark, assets_path):
    with pytest.raises(ContractError, match="missing"):
        load_assets(spark, assets_path, columns=["date", "nothing"])
    wrong = spark.createDataFrame([("2020-01-01", 1.0)], "date string, rf double")
    with pytest.raises(ContractError, match="expected date"):
        load_factors(spark, wrong)
    exposures = frame(spark, TINY, "fx_exposures")
    with pytest.raises(ContractError):
        load_exposures(spark, exposures, columns=["date", "barrid"], in_universe=True)


def test_exposures_of_universe_members(spark, assets_path):
    members = load_assets(spark, assets_path, columns=["date", "barrid"])
    dropped = members.first()
    assets = spark.read.parquet(assets_path).withColumn(
        "in_universe",
        ~((F.col("date") == F.lit(dropped.date)) & (F.col("barrid") == dropped.barrid)),
    )
    exposures = frame(spark, TINY, "fx_exposures")
    kept = load_exposures(
        spark, exposures, columns=["barrid", "USSLOWL_VALUE"], in_universe=True, universe=assets
    )
    assert kept.columns == ["barrid", "USSLOWL_VALUE"]
    assert kept.count() == exposures.count() - 1


def rows_of(df):
    return sorted((r.date, r.barrid, r.weight) for r in df.collect())


def test_weights_round_trip_and_rerun_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "weights")
    rows = [(dt.date(y, 6, 1), "a", float(y)) for y in (1995, 1996, 1997)]
    df = spark.createDataFrame(rows, "date date, barrid string, weight double")
    write_weights(df, path, "illiq", 50)
    write_weights(df, path, "illiq", 60)
    write_weights(df, path, "liquidity", 6000)
    assert rows_of(read_weights(spark, path, ["illiq"], [50])) == rows
    again = df.where(F.year("date") == 1996).withColumn("weight", F.lit(-1.0))
    write_weights(again, path, "illiq", 50)
    assert [r[2] for r in rows_of(read_weights(spark, path, {"illiq": 50}))] == [1995.0, -1.0, 1997.0]
    assert rows_of(read_weights(spark, path, {"illiq": 60})) == rows


def test_reading_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "weights")
    rows = [(dt.date(y, 6, 1), "a", 1.0) for y in (1995, 1996)]
    df = spark.createDataFrame(rows, "date date, barrid string, weight double")
    for gamma in (1, 2):
        write_weights(df, path, "s", gamma)
    chosen = read_weights(spark, path, {"s": 2}, start=dt.date(1996, 1, 1))
    assert len(chosen.inputFiles()) <= 4
    plan = executed(chosen)
    assert "PartitionFilters: [" in plan and "gamma" in plan.split("PartitionFilters: [")[1]
    assert [r.date.year for r in chosen.collect()] == [1996]
    both = ps.multi_signal_weights(spark, path, {"s": 1}, dt.date(1995, 1, 1), dt.date(1995, 12, 31))
    assert both.columns == ["date", "barrid", "weight", "signal"] and both.count() == 1


def test_alphas_of_two_signals_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "alphas")
    df = spark.createDataFrame([(dt.date(1995, 1, 1), "a", 0.1)], "date date, barrid string, alpha double")
    write_alphas(df, path, "one")
    write_alphas(df, path, "two")
    assert {r.signal for r in spark.read.parquet(path).collect()} == {"one", "two"}


def test_stage_lands_in_the_named_folder_and_cuts_lineage(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2.0)
    staged = stage(df.repartition(3))
    assert staged.dtypes == df.dtypes and staged.count() == 10
    assert all(staging_root(spark) in f for f in staged.inputFiles())
    assert "Exchange" not in executed(staged)


def test_release_drops_this_applications_copies(tmp_path, monkeypatch, spark):
    monkeypatch.setattr(staging, "staging_root", lambda session: str(tmp_path))
    staging.stage(spark.range(3))
    folder = tmp_path / "panelspark" / spark.sparkContext.applicationId
    assert folder.exists()
    staging.release(spark)
    assert not folder.exists() and tmp_path.exists()


def test_signal_comparison_reads_stored_weights(spark, assets_path, tmp_path):
    path = str(tmp_path / "weights")
    panel = load_assets(spark, assets_path, columns=["date", "barrid"])
    for signal, gamma, weight in (("momentum", 50, 0.5), ("barra_momentum", 50, -0.5)):
        write_weights(panel.withColumn("weight", F.lit(weight)), path, signal, gamma)
    write_weights(panel.withColumn("weight", F.lit(99.0)), path, "momentum", 51)
    report = plans.study_signal_comparison(
        spark, path, assets_path, dt.date(1992, 1, 1), dt.date(2000, 1, 1)
    )
    rows = {r.signal: r for r in report.summary.collect()}
    assert set(rows) == {"momentum", "barra_momentum"}
    assert rows["momentum"].mean_return == pytest.approx(-rows["barra_momentum"].mean_return)
