from __future__ import annotations

import pytest

from sievework.plans import catalog

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", [*catalog.QUERIES])
def test_query_equals_sql(spark, data, db, name):
    assert_same(catalog.QUERIES[name](spark, data), db, catalog.SQL[name])


def test_entry(spark, data):
    import __spark_entry__

    assert "group_id" in __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
