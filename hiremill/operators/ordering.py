"""Priority order, top-k and caps. A cap is a total order plus a limit, never a global row number."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions import dates
from hiremill.operators.dedupe import distinct_urls, ties


def priority_tier(published_at: Column, cutoff: Column) -> Column:
    """2 fresh, 1 undated, 0 stale."""
    return F.when(published_at.isNull(), 1).when(published_at >= cutoff, 2).otherwise(0)


def with_tier(candidates: DataFrame, *, now: datetime, max_age_hours: int) -> DataFrame:
    cutoff = dates.moment_literal(
        now - timedelta(hours=max_age_hours), candidates.schema["published_at"].dataType
    )
    return candidates.withColumn("tier", priority_tier(F.col("published_at"), cutoff))


def priority_order(order: Sequence[str]) -> list[Column]:
    return [F.col("tier").desc(), F.col("published_at").desc_nulls_last(), *[F.col(c).asc() for c in order]]


def prioritize(
    candidates: DataFrame, *, now: datetime, max_age_hours: int, order: Sequence[str] = ("position",)
) -> DataFrame:
    """Fresh first, then undated, then stale; newest first inside a tier, original order on ties."""
    ranked = with_tier(candidates, now=now, max_age_hours=max_age_hours)
    return ranked.orderBy(*priority_order(order), *ties(candidates))


def top_urls(
    candidates: DataFrame,
    k: int,
    *,
    now: datetime,
    max_age_hours: int,
    order: Sequence[str] = ("position",),
) -> DataFrame:
    """The first ``k`` distinct URLs of the priority order."""
    ranked = with_tier(candidates, now=now, max_age_hours=max_age_hours)
    best = priority_order(order)
    return distinct_urls(ranked, best).orderBy(*best, *ties(candidates)).limit(max(k, 0))


def limit_wanted(candidates: DataFrame, wanted: int, order: Sequence[str]) -> DataFrame:
    """The first ``wanted`` candidates in query order; a negative number gives none."""
    return candidates.orderBy(*order, *ties(candidates)).limit(max(wanted, 0))


def publish_cap(posts: DataFrame, max_posts: int, order: Sequence[str] = ("source_rank", "position")) -> DataFrame:
    """At most ``max_posts`` rows in source order; zero or less means no cap."""
    return posts.orderBy(*order, *ties(posts)).limit(max_posts) if max_posts > 0 else posts


def show_with_omitted(urls: DataFrame, k: int, order: Sequence[str], url: str = "url") -> DataFrame:
    """The first ``k`` URLs, and one closing row that counts the rest."""
    shown = urls.orderBy(*order, *ties(urls)).limit(max(k, 0)).select(F.col(url).alias("url"), F.lit(0).cast("bigint").alias("omitted"))
    rest = urls.agg(F.greatest(F.count(F.lit(1)) - max(k, 0), F.lit(0)).alias("omitted")).select(
        F.lit(None).cast("string").alias("url"), "omitted"
    )
    return shown.unionByName(rest)
