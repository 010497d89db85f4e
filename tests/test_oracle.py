"""Every registered query against its DuckDB statement on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.catalog import queries
from panelspark.catalog.fixtures import frame
from panelspark.catalog.oracle import all_statements
from panelspark.sources import stage
from tests.conftest import TINY

TABLES = ["supplier", "orders", "lineitem"]
TYPES = {"date": "DATE", "double": "DOUBLE", "bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TINY}/{name}.parquet'")
    yield con
    con.close()


@pytest.fixture(scope="module", autouse=True)
def shared_panels():
    """Derive each panel once for all queries of this module."""
    made = {}

    def cached(spark, folder, name):
        if (folder, name) not in made:
            made[folder, name] = stage(frame(spark, folder, name))
        return made[folder, name]

    original, queries.frame = queries.frame, cached
    yield
    queries.frame = original


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def test_same_names():
    assert set(queries.all_queries()) == set(all_statements())
    assert set(queries.all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.all_queries()))
def test_query_matches_its_statement(spark, duck, name):
    df = queries.all_queries()[name](spark, TINY)
    result = duck.sql(all_statements()[name])
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    kinds = dict(zip(result.columns, map(str, result.types)))
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == {c: kinds[c] for c in columns}
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    spots = [result.columns.index(c) for c in columns]
    theirs = sorted(tuple(cell(r[i]) for i in spots) for r in result.fetchall())
    assert ours == theirs


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
