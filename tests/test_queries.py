"""Every registered query against its SQL; the others must run and give rows."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    built = entry_points.queries()[name](spark, sf_dir)
    assert difference(built, con, entry_points.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_gives_rows(spark, sf_dir, name):
    assert not entry_points.queries()[name](spark, sf_dir).isEmpty()


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {"grp", "rank", "word", "score", "volume"} == set(rows[0].asDict())
    assert any(r.grp == "global" for r in rows)
