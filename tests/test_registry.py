"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbob.plans.queries import QUERIES as OWN
from tools.check import TABLES, compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 8


# Queries of the optional part without SQL have tests of their own.
@pytest.mark.parametrize("name", sorted({*OWN, *SQL}))
def test_query(spark, data, con, name):
    text, _, fine = compare(spark, con, name, QUERIES[name], SQL.get(name), data)
    assert fine, text
