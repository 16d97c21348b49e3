"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import database, differences


@pytest.fixture(scope="module")
def db(small):
    return database(small)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    rows_only = {name for name in set(queries()) - set(oracle_sql()) if not name.startswith("op") and name != "pipeline"}
    assert rows_only == set()


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["text_id", "pos", "value"] and found.count() == 200 * 16


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, db, small, name):
    rows, only = differences(spark, db, small, name)
    assert rows > 0 and only == []
