"""Every registered query against its DuckDB equivalent on the smallest given tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
import oracle_registry
import query_registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = query_registry.queries(), oracle_registry.oracle_sql()
WITHOUT_SQL: set[str] = set()
# On the smallest tables no column passes as normal.
MAY_BE_EMPTY = {"zscore", "zscore_two"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_registration():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    verdict, rows, _ = compare(spark, duck, SF_DIR, name, QUERIES[name], ORACLE.get(name))
    assert verdict == ("rows only" if name in WITHOUT_SQL else "ok")
    assert rows > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() == 8
