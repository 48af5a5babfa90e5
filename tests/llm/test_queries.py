"""The registered queries of the subpackage."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from hiremill.llm.catalog import ORACLES, QUERIES
from tests.oracle import duck_rows, spark_rows


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(duck, ORACLES[name])
