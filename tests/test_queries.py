"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.compare import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for file in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got, names = rows_of(df.columns, df.collect())
    expected, wanted = rows_of(columns, cursor.fetchall())
    assert names == wanted
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    if name == "multilabel":
        pytest.skip("covered in test_models")
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() == 5
    assert result.columns[:3] == ["node_id", "node_name", "equipment_id"]


def test_every_query_reads_the_tables():
    assert set(ORACLES) <= set(QUERIES)
