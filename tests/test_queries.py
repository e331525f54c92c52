"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from lorekeep import plans
from tools.check_oracle import TABLES, as_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
STREAMS = {name for name in QUERIES if name.startswith("stream_")}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"vector_ann"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    mine = as_rows(df.columns, df.collect())
    if name not in ORACLES:
        assert mine
        return
    result = duck.execute(ORACLES[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == as_rows(columns, result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 3
