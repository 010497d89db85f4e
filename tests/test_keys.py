"""Key contracts: what repeated and missing keys do."""

import pytest

import panelspark as ps
from panelspark.catalog.queries import all_queries
from tests.conftest import TINY, day
from tests.test_plan_shapes import plan_of, shuffles

PANEL = "date date, barrid string, `return` double"


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame(
        [(day(i), f"a{j}", float(i + j)) for i in range(60) for j in range(40)], PANEL
    )


def test_report_and_violations_are_exact(spark, clean):
    odd = [(day(3), "a1", 9.0), (day(3), "a1", 9.0), (None, "a1", 1.0), (None, "a1", 1.0), (day(1), None, 1.0)]
    df = clean.unionByName(spark.createDataFrame(odd, PANEL))
    assert ps.key_report(df, ["date", "barrid"]).first().asDict() == {
        "n_rows": 2405, "n_keys": 2400, "n_repeated": 2, "n_null_keys": 3,
    }
    found = {(r.date, r.barrid): r.n_rows for r in ps.key_violations(df, ["date", "barrid"]).collect()}
    assert found == {(day(3), "a1"): 3, (None, "a1"): 2, (day(1), None): 1}
    assert set(ps.key_report(df.limit(0), ["date", "barrid"]).first()) == {0}
    assert ps.key_violations(clean, ["date", "barrid"]).isEmpty()


def test_report_on_dealt_rows_is_the_same(spark, clean):
    odd = [(day(3), "a1", 9.0), (None, "a1", 1.0), (None, "a1", 1.0), (None, None, 1.0)]
    df = clean.unionByName(spark.createDataFrame(odd, PANEL))
    for keys in (["date", "barrid"], ["barrid"]):
        assert ps.key_report(df, keys, partitions=7).first() == ps.key_report(df, keys).first()
    assert set(ps.key_report(df.limit(0), ["date", "barrid"], partitions=7).first()) == {0}


def test_no_task_counts_keys_beside_the_aggregate_of_a_panel(spark):
    plan = plan_of(all_queries()["key_report"](spark, TINY))
    for steps in plan.split("Exchange"):
        assert not ("HashAggregate(keys=[l_suppkey" in steps and "count(1)" in steps)
    assert plan.count("Exchange SinglePartition, ENSURE") == 5  # no report in the union's task


def test_observed_while_a_job_reads(clean):
    df, seen = ps.observe_keys(clean, ["date", "barrid"])
    assert shuffles(ps.forward_returns(df)) == 1
    ps.forward_returns(df).write.format("noop").mode("overwrite").save()
    got = seen.get
    assert (got["n_rows"], got["n_null_keys"]) == (2400, 0)
    assert got["n_keys_estimate"] == pytest.approx(2400, rel=0.04)
    assert not ps.suspects_repeats(got)
    twice, seen = ps.observe_keys(clean.unionByName(clean.where("barrid < 'a2'")), ["date", "barrid"])
    twice.write.format("noop").mode("overwrite").save()
    assert ps.suspects_repeats(seen.get)


def test_sketches_of_parts_merge(clean):
    from pyspark.sql import functions as F

    parts = ps.key_sketches(clean, ["date", "barrid"], F.month("date"))
    assert parts.count() == 2 + (day(59).month > 2)
    whole = ps.merge_sketches(parts.unionByName(parts)).first()
    # Sketches of the same keys add rows, not keys.
    assert whole.n_rows == 4800 and whole.n_keys_estimate == pytest.approx(2400, rel=0.04)
    assert ps.suspects_repeats(whole.asDict())
    assert not ps.suspects_repeats(ps.merge_sketches(parts).first().asDict())


def test_a_repeated_row_fails_the_job_and_costs_no_shuffle(spark, clean):
    checked = ps.refuse_repeats(clean)
    assert checked.columns == clean.columns
    assert shuffles(ps.forward_returns(checked)) == 1
    assert sorted(map(repr, checked.collect())) == sorted(map(repr, clean.collect()))
    again = clean.unionByName(spark.createDataFrame([(day(3), "a1", 9.0)], PANEL))
    with pytest.raises(Exception, match=r"repeated \(date, barrid\): 2020-01-04, a1"):
        ps.forward_returns(ps.refuse_repeats(again)).select("barrid", "date").collect()
    nulls = clean.unionByName(spark.createDataFrame([(None, "a1", 9.0)], PANEL))
    assert ps.refuse_repeats(nulls).count() == 2401
    with pytest.raises(Exception, match="NULL, a1"):
        ps.refuse_repeats(nulls.unionByName(nulls.where("date IS NULL"))).collect()


def test_a_repeated_factor_date_is_refused(spark):
    factors = spark.createDataFrame([(day(i), float(i)) for i in (0, 1, 2)], "date date, mkt_rf double")
    assert {r.date: r.mkt_rf for r in ps.lead_factors(factors).collect()} == {day(0): 1.0, day(1): 2.0, day(2): None}
    again = factors.unionByName(factors.where("mkt_rf = 1"))
    with pytest.raises(Exception, match="repeated date: 2020-01-02"):
        ps.lead_factors(again).select("date").collect()
    returns = spark.createDataFrame([(day(0), "0", 0.1)], "date date, bin string, `return` double")
    with pytest.raises(Exception, match="repeated date"):
        ps.regression_frame(returns, ps.lead_factors(again.withColumn("rf", again.mkt_rf))).collect()
