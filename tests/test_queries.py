"""Every registered query next to its SQL, on whole tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, sf_dir, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["stock_id", "time_id", "rv"] and result.count() > 0
