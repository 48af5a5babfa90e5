"""Filters on computed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, columns: dict[str, Column], keep: Callable[[Column], Column]) -> DataFrame:
    """Compute the columns and keep rows by them.

    A plain filter above a projection is pushed below it and computes its inputs a second
    time, which for parsed JSON, dates or links doubles the work of the scan. Here the row
    is built once and tested as it is.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(F.explode(F.filter(F.array(row), keep)).alias("_row")).select("_row.*")
