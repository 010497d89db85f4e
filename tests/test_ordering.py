import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

import panelspark as ps
from panelspark.catalog import fixtures
from panelspark.operators import ordering
from tests.conftest import TINY, day

SCHEMA = "date date, asset string, x double"


def skewed(seed=3, rows=3000):
    """A third of the rows on one date, a third of those with one value, some missing."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        hot = i % 3 == 0
        x = float(rng.normal())
        if hot and i % 9 == 0:
            x = 0.0
        elif i % 31 == 0:
            x = None
        out.append((day(0) if hot else day(1 + i % 40), f"a{i:05d}", x))
    return out


def linear_bins(values, n):
    """Bin numbers from sorted order statistics, the plain way."""
    known = np.sort(values[~np.isnan(values)])
    cuts = []
    for k in range(1, n):
        spot = k / n * (len(known) - 1)
        low = int(np.floor(spot))
        high = int(np.ceil(spot))
        cuts.append(known[low] + (known[high] - known[low]) * (spot - low))
    return [None if np.isnan(v) else str(sum(v > c for c in cuts)) for v in values]


def test_bins_match_brute_force_on_a_hot_date(spark, many_pieces):
    rows = skewed()
    pdf = pd.DataFrame(rows, columns=["date", "asset", "x"])
    want = {}
    for date, group in pdf.groupby("date"):
        for asset, label in zip(group.asset, linear_bins(group.x.to_numpy(float), 5)):
            want[date, asset] = label
    df = spark.createDataFrame(rows, SCHEMA)
    out = ps.quantile_bins(df, "x", 5, strict=False)
    assert {(r.date, r.asset): r.bin for r in out.collect()} == want


def test_hot_date_and_hot_value_are_spread_over_partitions(spark, many_pieces):
    laid = ordering.lay_out(spark.createDataFrame(skewed(), SCHEMA), ["date"], "x", ["asset"])
    piece = F.shiftright("_slot", 33)
    hot = laid.where(F.col("date") == F.lit(day(0)))
    assert hot.select(piece).distinct().count() > 1
    sizes = [r["count"] for r in laid.groupBy(piece).count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)


def test_ranks_match_brute_force(spark, many_pieces):
    rows = skewed(rows=900)
    pdf = pd.DataFrame(rows, columns=["date", "asset", "x"]).dropna()
    pdf = pdf.sort_values(["date", "x", "asset"])
    pdf["rank"] = pdf.groupby("date").cumcount() + 1
    pdf["mean_rank"] = pdf.groupby("date").x.rank(method="average")
    pdf["size"] = pdf.groupby("date").x.transform("size")
    df = spark.createDataFrame(rows, SCHEMA)
    laid = ordering.lay_out(df, ["date"], "x", ["asset"])
    got = {
        (r.date, r.asset): (r._rank, r._size)
        for r in ordering.with_ranks(laid, ["date"], "x").collect()
        if r.x is not None
    }
    assert got == {(r.date, r.asset): (r.rank, r.size) for r in pdf.itertuples()}
    averaged = ordering.average_ranks(df, ["date"], "x", ["asset"], "m").collect()
    assert {(r.date, r.asset): r.m for r in averaged if r.x is not None} == {
        (r.date, r.asset): r.mean_rank for r in pdf.itertuples()
    }
    assert {r.m for r in averaged if r.x is None} == {None}


def test_signal_stats_match_numpy(spark, many_pieces):
    rows = skewed()
    x = np.array([r[2] for r in rows if r[2] is not None])
    row = ps.signal_stats(spark.createDataFrame(rows, SCHEMA), "x").first()
    assert row.mean == pytest.approx(x.mean())
    assert row.std == pytest.approx(x.std(ddof=1))
    assert (row.min, row.max) == (x.min(), x.max())
    for name, q in [("q25", 25), ("q50", 50), ("q75", 75)]:
        assert row[name] == pytest.approx(np.percentile(x, q), abs=1e-15)


def test_strict_bins_refuse_equal_breaks(spark):
    df = spark.createDataFrame([(day(0), "a", 1.0)], SCHEMA)
    with pytest.raises(SparkRuntimeException, match="duplicate quantile breaks"):
        ps.quantile_bins(df, "x", 5).collect()
    assert ps.quantile_bins(df, "x", 5, strict=False).first().bin == "0"


def test_interval_is_open_below_and_closed_above(spark):
    df = spark.createDataFrame([(day(0), str(i), float(i)) for i in range(6)], SCHEMA)
    out = ps.quantile_bins(df, "x", 5).orderBy("x").collect()
    assert [r.bin for r in out] == ["0", "0", "1", "2", "3", "4"]


def test_rank_bins_break_ties_by_asset(spark):
    df = spark.createDataFrame([(day(0), f"{i}", 7.0) for i in range(10)], SCHEMA)
    out = ps.rank_quantile_bins(df, "x", 5, tiebreak=["asset"]).orderBy("asset").collect()
    assert [r.bin for r in out] == ["0", "0", "1", "1", "2", "2", "3", "3", "4", "4"]


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.integers(1, 23), min_size=1, max_size=6), st.integers(2, 7))
def test_rank_bins_are_monotone_and_even(spark, sizes, n):
    rows = [
        (day(d), f"{i:03d}", float((i * 7) % size))
        for d, size in enumerate(sizes)
        for i in range(size)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ps.rank_quantile_bins(df, "x", n, tiebreak=["asset"]).toPandas()
    for d, size in enumerate(sizes):
        group = out[out.date == day(d)].sort_values(["x", "asset"])
        labels = group.bin.astype(int).tolist()
        assert labels == sorted(labels)
        counts = np.bincount(labels, minlength=n)
        assert counts.max() - counts.min() <= 1


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ps.quantile_bins(df, "x", 5).count() == 0
    assert ps.signal_stats(df, "x").first().q50 is None


def test_zscores(spark):
    rows = [(day(0), str(i), float(i)) for i in range(9)]
    rows += [(day(1), "solo", 3.0), (day(2), "a", 2.0), (day(2), "b", 2.0)]
    out = ps.zscore_by_date(spark.createDataFrame(rows, SCHEMA), "x").toPandas()
    first = out[out.date == day(0)].score
    assert first.mean() == pytest.approx(0, abs=1e-12) and first.std() == pytest.approx(1)
    raw = ps.zscore_by_date(spark.createDataFrame(rows, SCHEMA), "x").collect()
    scores = {r.asset: r.score for r in raw if r.date != day(0)}
    assert scores["solo"] is None
    assert np.isnan(scores["a"]) and np.isnan(scores["b"])


def test_bins_do_not_depend_on_row_order_or_partitions(spark):
    df = spark.createDataFrame(skewed(rows=600), SCHEMA)
    shuffled = df.orderBy(F.rand(3)).repartition(7)

    def labels(frame):
        out = ps.quantile_bins(frame, "x", 4, strict=False)
        return {(r.date, r.asset): r.bin for r in out.collect()}

    assert labels(df) == labels(shuffled)


def test_a_supplier_with_a_third_of_all_lines_is_combined_before_the_shuffle(spark):
    """The derived panel holds one row per asset and date however many lines feed it."""
    lines = spark.read.parquet(f"{TINY}/lineitem.parquet")
    hot = lines.withColumn(
        "l_suppkey",
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(1)).otherwise(F.col("l_suppkey")).cast("long"),
    )
    cells = spark.sql(fixtures.BODIES["fx_cells"], lineitem=hot)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")
    per_asset = cells.groupBy("asset").count().orderBy(F.desc("count")).first()
    assert per_asset["count"] <= lines.select(F.to_date("l_shipdate")).distinct().count()
    assert cells.count() == cells.select("asset", "date").distinct().count()


def test_shared_ranks_of_hot_values_and_a_hot_date(spark, many_pieces):
    """A third of the rows share a value, half share a date; ranks of both columns in one pass."""
    import pandas as pd

    from panelspark.operators.ordering import shared_ranks

    rng = np.random.default_rng(8)
    n = 3000
    pdf = pd.DataFrame(
        {
            "date": [day(0) if i % 2 else day(int(i) % 7) for i in range(n)],
            "a": np.where(np.arange(n) % 3 == 0, 1.5, np.round(rng.normal(size=n), 2)),
            "b": np.where(rng.random(n) < 0.1, -0.0, np.round(rng.normal(size=n), 1)),
        }
    )
    got = shared_ranks(spark.createDataFrame(pdf), "date", ["a", "b"]).toPandas()
    assert len(got) == n
    for c in "ab":
        pdf[f"rank_{c}"] = pdf.groupby("date")[c].rank()
    columns = ["date", "a", "b", "rank_a", "rank_b"]
    ours = sorted(map(tuple, got[columns].to_numpy().tolist()))
    assert ours == sorted(map(tuple, pdf[columns].to_numpy().tolist()))
