"""Every query against DuckDB on the smallest tables."""

import os

import pytest

import oracle
from vicinity.queries import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL = catalogue()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_matches_sql(spark, con, name):
    run, sql = ALL[name]
    found = oracle.differences(run(spark, FOLDER), con, sql)
    assert found in (None, "no rows on either side"), found


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if not sql])
def test_gives_rows(spark, name):
    assert ALL[name][0](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["parcel_id", "inspection_date", "total"]
