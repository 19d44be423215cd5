"""Every named query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, differences

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, name):
    assert differences(QUERIES[name](spark, tiny), connect(tiny), SQL[name]) is None


# The other release rules are covered, batch by batch, in test_streaming.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"stream_training_bounded", "stream_training_eventual"}))
def test_gives_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["shard"] for r in rows} == {0, 1, 2, 3}
