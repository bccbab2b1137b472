"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_points

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert compare.difference(entry_points.queries()[name](spark, sf), con, SQL[name]) is None


def test_brief_has_one_row_per_source(spark, sf):
    rows = entry_points.queries()["report_brief"](spark, sf).collect()
    assert len(rows) == len({r.source for r in rows}) > 0
    assert all(r.brief.startswith("# PRODUCT report on ") for r in rows)
    assert all("PRODUCT REPORT:" in r.brief for r in rows)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
