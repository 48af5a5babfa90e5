"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from hiremill.catalog import ORACLES, QUERIES
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    columns, rows = spark_rows(QUERIES[name](spark, small))
    expected_columns, expected = duck_rows(duck, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_queries_without_sql_give_rows(spark, small):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, small).count() > 0, name


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["fingerprint", "k", "source", "title", "card"]
    assert 0 < rows.count() <= 200
