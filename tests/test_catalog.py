"""Every query with SQL must give the same rows in DuckDB; the others must give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from txrisk.catalog import aggregates, models, rows, streams, tables  # noqa: F401  (they register)
from txrisk.catalog import registry
from tests.conftest import DATA

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield con
    con.close()


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(tuple(comparable(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(comparable(row[i]) for i in order) for row in result.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 2
