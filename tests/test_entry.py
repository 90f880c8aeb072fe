"""The driver contract: every query has a callable, SQL names only queries, entry gives rows."""

import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert entry.entry(spark).count() > 0
