"""Every registered query runs on the smallest tables and equals its SQL on DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from tables import SF

LARGER = SF.replace("sf0.001", "sf0.01")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, rows, _ = compare(spark, con, SF, QUERIES[name], SQL.get(name))
    if status == "EMPTY":  # groups of a least size that the smallest tables do not have
        status, rows, _ = compare(spark, connect(LARGER), LARGER, QUERIES[name], SQL.get(name))
    assert status in ("ok", "rows-only"), status


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
