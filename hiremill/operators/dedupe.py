"""Identity, first-wins dedupe and the check against the published ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.functions.identity import post_fingerprint

_SPREAD = 64


def with_fingerprint(posts: DataFrame) -> DataFrame:
    return posts.withColumn("fingerprint", post_fingerprint())


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows per key in a total order, optionally with their rank.

    Spark cuts each key to one row per task before the shuffle where one row is wanted.
    More rows are first taken from slices of each key, so that a key holding much of the
    table is sorted by many tasks and the last one sees at most ``n`` rows per slice.
    """
    if n <= 0:
        return df.limit(0) if rank is None else df.withColumn(rank, F.lit(0)).limit(0)
    if n > 1:
        names = df.columns
        df = df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(c) for c in hashable(df)]), F.lit(_SPREAD)))
        part = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_part_rank", F.row_number().over(part)).filter(F.col("_part_rank") <= n).select(*names)
    label = rank or "_rank"
    ranked = df.withColumn(label, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(label) <= n)
    return kept if rank else kept.drop(label)


def hashable(df: DataFrame) -> list[str]:
    """Columns xxhash64 accepts; maps and variants are not among them."""
    kinds = ((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return [name for name, kind in kinds if "map<" not in kind and "variant" not in kind]


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in processing order."""
    return first_n(df, keys, order, 1)


def drop_seen(posts: DataFrame, ledger: DataFrame, on: str = "fingerprint") -> DataFrame:
    """Posts whose fingerprint the ledger does not hold."""
    return posts.join(ledger.select(on), on, "left_anti")


def drop_seen_batch(batch: DataFrame, ledger: DataFrame, on: str = "fingerprint") -> DataFrame:
    """The same for a small stored batch and a large ledger.

    The ledger is first reduced to the keys of the batch. Spark broadcasts those when the
    stored batch is small, so the ledger is scanned in place and never shuffled.
    """
    met = ledger.select(on).join(batch.select(on), on, "left_semi")
    return batch.join(met, on, "left_anti")


def new_posts(posts: DataFrame, ledger: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Unseen posts, each fingerprint once.

    Dedupe comes first: it leaves one row per fingerprint, already partitioned by the
    key of the anti join, so a fingerprint with very many copies never meets the ledger.
    """
    return drop_seen(first_wins(posts, ["fingerprint"], order), ledger)


def ties(df: DataFrame) -> list[Column]:
    """All columns with an order, to end an order that may hold ties."""
    return [F.col(c) for c in hashable(df)]


def distinct_urls(candidates: DataFrame, order: Sequence[Column], url: str = "url") -> DataFrame:
    """Each URL once, with the provenance of its first hit; other columns decide between hits of one place."""
    known = candidates.filter(F.coalesce(F.col(url), F.lit("")) != "")
    return first_wins(known, [url], [*order, *ties(known)])
