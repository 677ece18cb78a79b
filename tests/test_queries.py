"""Every registered query runs, and equals its SQL on the smallest tables."""

import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = pathlib.Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canon(value):
    if value is None or isinstance(value, (str, bool)):
        return repr(value)
    return repr(round(float(value), 6))


def test_each_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, database):
    rows = QUERIES[name](spark, str(SF))
    columns = sorted(rows.columns)
    if name not in ORACLES:
        assert rows.count() > 0
        return
    got = sorted(tuple(canon(v) for v in r) for r in rows.select(*columns).collect())
    result = database.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(canon(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
