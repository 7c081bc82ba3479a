"""Every registered query of the engine against its SQL."""

import pytest
from compare import check

from presswire.queries import ORACLES, QUERIES

#: Their tables have no such rows at this size.
MAY_BE_EMPTY = {"stream_task_timing"}
NO_SQL: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_query(spark, sf_dir, duck, name):
    n = check(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))
    assert n or name in MAY_BE_EMPTY


def test_every_query_has_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
