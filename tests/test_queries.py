"""Registered queries against their SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry

# Columns of flow statistics one by one; flw19 covers them together.
PARTS = {f"flw{i}_" for i in range(7, 18)}
NAMES = [n for n in entry.oracle_sql() if not any(n.startswith(p) for p in PARTS)]


@pytest.fixture(scope="module")
def con(sf):
    return check.database(sf)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, sf, name):
    _, problems = check.differences(spark, con, name, sf)
    assert not problems


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_flow_columns(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 45 and df.count() == 27
