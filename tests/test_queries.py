"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from stratawork import catalogue
from oracle import compare, connect

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert set(catalogue.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    difference = compare(spark, con, name, SF_DIR)
    if difference == "no rows on either side":  # the smallest tables may hold no case; the next ones must
        difference = compare(spark, connect(LARGER), name, LARGER)
    assert difference == ""


def test_entry(spark):
    assert entry(spark).count() > 0
