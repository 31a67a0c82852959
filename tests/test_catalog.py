"""Every catalog query against its SQL in DuckDB, and rows from those that have none."""

import os

import pytest

from compare import duck, rows
from weftcode.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_the_whole_rate_distortion_sweep_is_run(spark):
    rows = catalog.QUERIES["huffman_rate"](spark, DATA).orderBy("multiplier").collect()
    assert [r.multiplier for r in rows] == [0.05, 0.1, 0.2, 0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert all(a.bits_per_component > b.bits_per_component and a.mse < b.mse for a, b in zip(rows, rows[1:]))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
