"""Named queries against their SQL on the smallest tables; those without SQL must run. Text operators have tests of their own."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, compare
from checks.registry import REGISTRY

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [q.name for q in REGISTRY.values()])
def test_query_agrees_with_its_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    text, _ = compare(spark, con, SF, name, sql)
    assert text.startswith("ok" if sql else "rows"), text


def test_every_sql_has_its_query_and_the_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
