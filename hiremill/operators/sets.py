"""Unions of sources and set differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.operators.dedupe import drop_seen


def union_sources(sources: Sequence[tuple[str, DataFrame | None]]) -> DataFrame:
    """All sources in registry order with their rank; a source that could not be read is None.

    At least one must have been read, as a table without any has no columns.
    """
    read = [(rank, name, df) for rank, (name, df) in enumerate(sources) if df is not None]
    if not read:
        raise ValueError("no source could be read")
    tagged = [
        df.withColumn("source_rank", F.lit(rank)).withColumn("source", F.lit(name)) for rank, name, df in read
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tagged)


def only_new(current: DataFrame, published: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Keys of the current posts that were never published, each once."""
    return drop_seen(current.select(key).distinct(), published, key)
