"""Every registered query against its SQL twin."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

RUNS, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = connect(sf)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    assert compare(RUNS[name](spark, sf), duck, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert RUNS[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(RUNS)
