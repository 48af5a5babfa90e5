"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.common import stored


def components(links: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node it reaches.

    Each round hangs neighbours on smaller nodes until the links form stars, so the number of
    rounds grows with the logarithm of the longest chain. Only counts and checksums reach the
    driver. A node with many links is split by the adaptive skew join: both sides of the join
    below are plain shuffles. Links with a null end and loops are left out; no links, no rows.
    """
    a, b = F.col(left), F.col(right)
    pairs = stored(
        links.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "links"
    )
    state = _state(pairs)
    while state[0]:
        pairs = stored(_small_star(stored(_large_star(pairs), "large-star")), "small-star")
        before, state = state, _state(pairs)
        if state == before:
            break
    root = pairs.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(root)


def _state(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("high", "low")), F.lit(0)).alias("h")
    ).first()
    return row["n"], row["h"]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node next to it."""
    both = pairs.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
        pairs.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )
    least = stored(
        both.groupBy("node").agg(F.min("other").alias("next")).select("node", F.least("node", "next").alias("least")),
        "least",
    )
    return (
        both.where(F.col("other") > F.col("node"))
        .join(least, "node")
        .select(F.col("other").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = stored(pairs.groupBy("high").agg(F.min("low").alias("least")), "least")
    moved = (
        pairs.join(least, "high")
        .where(F.col("low") != F.col("least"))
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
    )
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()
