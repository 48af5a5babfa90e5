"""Reports: counts per source, provider, family and date class."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions import dates
from hiremill.functions.extract import safe_error_type
from hiremill.functions.text import strip

# place of a candidate; pass more columns where positions restart in every result list
CANDIDATE_ORDER = ("position",)


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def with_url(candidates: DataFrame) -> DataFrame:
    """Candidates with a URL, without the blanks around it."""
    return candidates.withColumn("url", strip(F.coalesce(F.col("url"), F.lit("")))).filter(F.col("url") != "")


def _first(value: str, order: Sequence[str], known: Column | None = None) -> Column:
    """The value at the first place; the value itself decides between rows of one place."""
    place = F.struct(*[F.col(c) for c in order], F.col(value))
    return F.min_by(value, place if known is None else F.when(known, place))


def ledger_counts(published: DataFrame, applications: DataFrame) -> DataFrame:
    """Row counts of both ledgers, as one row."""
    tagged = published.select(F.lit("p").alias("t")).unionByName(applications.select(F.lit("a").alias("t")))
    return tagged.agg(
        _count(F.col("t") == "p").alias("published"), _count(F.col("t") == "a").alias("applications")
    )


def provider_status(errors: Column, attempted: Column) -> Column:
    return (
        F.when((attempted > 0) & (errors >= attempted), "error").when(errors > 0, "degraded").otherwise("ok")
    )


def provider_report(candidates: DataFrame, query_log: DataFrame) -> DataFrame:
    """Per provider that was asked: distinct URLs, queries, errors, first error type, status.

    candidates: provider, url. query_log: provider, ord, ok, error_type.
    """
    failed = ~F.col("ok")
    asked = query_log.groupBy("provider").agg(
        F.count(F.lit(1)).alias("queries_attempted"),
        _count(failed).alias("query_errors"),
        F.min_by("error_type", F.when(failed, F.col("ord"))).alias("error_type"),
    )
    found = with_url(candidates).groupBy("provider").agg(F.count_distinct("url").alias("candidate_count"))
    return asked.join(found, "provider", "left").select(
        "provider",
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        "queries_attempted",
        "query_errors",
        "error_type",
        provider_status(F.col("query_errors"), F.col("queries_attempted")).alias("status"),
    )


def family_counts(candidates: DataFrame, order: Sequence[str] = CANDIDATE_ORDER) -> DataFrame:
    """URLs per provider and family; a URL counts for the family that saw it first."""
    first = with_url(candidates).groupBy("provider", "url").agg(_first("family", order).alias("family"))
    return first.groupBy("provider", "family").agg(F.count(F.lit(1)).alias("urls"))


def url_date_hints(candidates: DataFrame, order: Sequence[str] = CANDIDATE_ORDER) -> DataFrame:
    """The first known date of every URL, in processing order."""
    first = _first("published_at", order, F.col("published_at").isNotNull())
    return with_url(candidates).groupBy("url").agg(first.alias("published_at"))


def date_hint_counts(
    candidates: DataFrame, *, now: datetime, max_age_hours: int, order: Sequence[str] = CANDIDATE_ORDER
) -> DataFrame:
    hints = url_date_hints(candidates, order)
    cutoff = dates.moment_literal(now - timedelta(hours=max_age_hours), hints.schema["published_at"].dataType)
    published = F.col("published_at")
    return hints.agg(
        _count(published >= cutoff).alias("fresh_date_hints"),
        _count(published < cutoff).alias("stale_date_hints"),
        _count(published.isNull()).alias("undated"),
    )


def discovery_report(
    candidates: DataFrame,
    query_log: DataFrame,
    *,
    now: datetime,
    max_age_hours: int,
    order: Sequence[str] = CANDIDATE_ORDER,
) -> DataFrame:
    """One row over all providers; its status tells a dead setup from an empty one."""
    known = candidates.join(query_log.select("provider").distinct(), "provider", "left_semi")
    providers = provider_report(known, query_log).agg(
        F.count(F.lit(1)).alias("providers"),
        F.sum("candidate_count").alias("candidate_count"),
        _count(F.col("status") == "error").alias("errors"),
        _count(F.col("status") == "degraded").alias("degraded"),
    )
    hints = date_hint_counts(known, now=now, max_age_hours=max_age_hours, order=order)
    both = providers.unionByName(hints, allowMissingColumns=True)
    total = both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in both.columns])
    unique = F.col("fresh_date_hints") + F.col("stale_date_hints") + F.col("undated")
    status = (
        F.when(F.col("providers") == 0, "misconfigured")
        .when(F.col("errors") == F.col("providers"), "provider_error")
        .when((F.col("errors") > 0) | (F.col("degraded") > 0), "degraded")
        .when(unique == 0, "no_results")
        .otherwise("ok")
    )
    return total.select(
        status.alias("status"), "providers", "candidate_count", unique.alias("unique_count"),
        "fresh_date_hints", "stale_date_hints", "undated",
    )


def source_preview_counts(posts: DataFrame, kept: Column) -> DataFrame:
    """Fetched and kept posts per source."""
    return posts.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), _count(kept).alias("filtered"))


def error_type_counts(errors: DataFrame, name: str = "error_name", code: str = "status_code") -> DataFrame:
    """Failures per harmless label: ``Http<code>`` when a code is known, else the cleaned class name."""
    label = F.when(F.col(code).isNotNull(), F.concat(F.lit("Http"), F.col(code).cast("string"))).otherwise(
        safe_error_type(F.col(name))
    )
    return errors.select(label.alias("error_type")).groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))
