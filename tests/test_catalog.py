"""Every query with SQL gives the rows of that SQL on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from tidewright.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in "orders lineitem events".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        assert got == table([d[0] for d in cursor.description], cursor.fetchall())
    else:
        assert got[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
