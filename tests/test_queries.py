"""Every core query runs, and agrees with its SQL where it has one."""

import pytest

from shardloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same_as_duckdb):
    same_as_duckdb(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
