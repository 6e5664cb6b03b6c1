"""Every registered query against its SQL; queries without SQL must give rows."""

import pytest

import __spark_entry__ as entry
import compare

# At the smallest scale no file has the unusable layout.
MAY_BE_EMPTY = {"conform_required"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf_dir, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, sf_dir).count() > 0
        return
    found = compare.differences(spark, con, fn, sql, sf_dir)
    assert found is None or (found == "no rows" and name in MAY_BE_EMPTY), found


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
