"""Joins with tables of few rows per group: whole results, and nothing large through the driver."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import jaccard, prefix_trie
from panelspark.llm.common import attach
from panelspark.sources import stage
from tests.conftest import TINY


def plan_of(df):
    """The plan that ran, written out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sides(spark):
    """Rows with a hot key, null keys and keys without a match; one staged row per key."""
    keys = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 900)
    rows = spark.range(3000).select(keys.alias("k"), F.col("id").alias("n"))
    small = spark.range(800).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 10).alias("v"))
    return rows, stage(small)


@pytest.mark.parametrize("most", [799, 800])
def test_attach_is_a_null_safe_left_join(sides, most):
    rows, small = sides
    values = {r.k: r.v for r in small.collect()}
    got = attach(rows, small, ["k"], most)
    assert got.columns == ["k", "n", "v"]
    assert sorted((r.n, r.v) for r in got.collect()) == sorted((r.n, values.get(r.k)) for r in rows.collect())


def test_repeated_tables_are_not_broadcast(sides):
    rows, small = sides
    plan = plan_of(attach(rows, small, ["k"], most=799))
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan
    assert "BroadcastHashJoin" in plan_of(attach(rows, small, ["k"], most=800))


@pytest.fixture
def watched(monkeypatch):
    """Plans of the joins that a module makes with ``attach``, here with at most ``most`` rows broadcast."""

    def watch(module, **most):
        plans = []

        def kept(rows, small, on):
            out = attach(rows, small, on, **most)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(module, "attach", kept)
        return plans

    return watch


def salted_joins(plans):
    return [m[0] for plan in plans for m in re.finditer(r"\w+Join \[[^\n]*_salt#", plan)]


def test_trie_of_many_joints_sends_no_repeated_table_through_the_driver(spark, watched):
    plans, pairs = watched(prefix_trie), 10_001
    rows = spark.range(2 * pairs).select(
        F.col("id").alias("conv_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"),
    ).select(
        "conv_id",
        "turn",
        F.lit("user").alias("role"),
        F.when(F.col("turn") == 1, F.floor(F.col("conv_id") / 2)).otherwise(F.col("conv_id")).cast("string").alias("text"),
    )
    trie = prefix_trie.shared_prefixes(rows)
    found = trie.groupBy("depth", "n_children").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"))
    assert sorted(map(tuple, found.collect())) == [(0, pairs, 1, 2 * pairs), (1, 2, pairs, 2 * pairs), (2, 0, 2 * pairs, 2 * pairs)]
    assert [join.split()[0] for join in salted_joins(plans)] == ["SortMergeJoin"]


def test_pipeline_sends_no_repeated_table_of_differences_through_the_driver(spark, watched):
    def edited(places, mark):
        return " ".join(f"{mark}{i}" if i in places else f"w{i}" for i in range(200))

    # Near copies of one text, and three that share eight edits: too far from it to link, but near each other.
    texts = [edited([], "")] + [edited([20 * i], f"own{i}x") for i in range(6)]
    texts += [edited(range(12, 200, 24), "shared") + f" end{i}" for i in range(3)]
    docs = stage(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], corpus_pipeline.COLUMNS))
    plans = watched(jaccard, most=0)
    kept = corpus_pipeline.near_duplicates(spark, docs, TINY).collect()
    assert sorted(r.doc_id for r in kept) == [0, 7]
    assert [join.split()[0] for join in salted_joins(plans)] == ["SortMergeJoin"]
