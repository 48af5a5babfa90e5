"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill import terms
from hiremill.catalog.base import (
    CUTOFF_SQL,
    MAX_AGE_HOURS,
    NOW,
    OPERATORS,
    candidates,
    ledger,
    lit,
    posts,
    query,
    query_log,
    table,
    updates,
    with_views,
)
from hiremill.catalog.filters import FRESH_SQL, ROLE_SQL
from hiremill.functions import dates
from hiremill.functions.extract import error_reason
from hiremill.operators import aggregates, applications, filters
from hiremill.plans import jobs


@query(
    "ledger_counts",
    with_views(
        ["ledger"],
        "SELECT (SELECT count(*) FROM ledger) AS published, (SELECT count(*) FROM events) AS applications",
    ),
)
def ledger_counts(spark, folder):
    return aggregates.ledger_counts(ledger(spark, folder), table(spark, folder, "events"))


_REPORT = (
    "SELECT provider, coalesce(n, 0) AS candidate_count, queries_attempted, query_errors, error_type, "
    "CASE WHEN query_errors >= queries_attempted THEN 'error' WHEN query_errors > 0 THEN 'degraded' ELSE 'ok' END AS status "
    "FROM (SELECT provider, count(*) AS queries_attempted, count(*) FILTER (WHERE NOT ok) AS query_errors, "
    "arg_min(error_type, ord) FILTER (WHERE NOT ok) AS error_type FROM qlog GROUP BY provider) "
    "LEFT JOIN (SELECT provider, count(DISTINCT url) AS n FROM cands WHERE url <> '' GROUP BY provider) USING (provider)"
)


@query("provider_report", with_views(["cands", "qlog"], _REPORT))
def provider_report(spark, folder):
    return aggregates.provider_report(candidates(spark, folder), query_log(spark, folder))


@query(
    "family_counts",
    with_views(
        ["cands"],
        "SELECT provider, family, count(*) AS urls FROM (SELECT provider, url, arg_min(family, position) AS family "
        "FROM cands WHERE url <> '' GROUP BY provider, url) GROUP BY provider, family",
    ),
)
def family_counts(spark, folder):
    return aggregates.family_counts(candidates(spark, folder))


_HINTS = (
    "SELECT url, arg_min(published_at, position) FILTER (WHERE published_at IS NOT NULL) AS published_at "
    "FROM cands WHERE url <> '' GROUP BY url"
)
_HINT_COUNTS = (
    f"count(*) FILTER (WHERE published_at >= {CUTOFF_SQL}) AS fresh_date_hints, "
    f"count(*) FILTER (WHERE published_at < {CUTOFF_SQL}) AS stale_date_hints, "
    "count(*) FILTER (WHERE published_at IS NULL) AS undated"
)


@query("date_hint_counts", with_views(["cands"], f"SELECT {_HINT_COUNTS} FROM ({_HINTS})"))
def date_hint_counts(spark, folder):
    return aggregates.date_hint_counts(
        candidates(spark, folder), now=NOW, max_age_hours=MAX_AGE_HOURS
    )


@query(
    "discovery_report",
    with_views(
        ["cands", "qlog"],
        f"""SELECT 'degraded' AS status, (SELECT count(*) FROM ({_REPORT})) AS providers,
  (SELECT sum(candidate_count) FROM ({_REPORT})) AS candidate_count, count(*) AS unique_count, {_HINT_COUNTS}
FROM ({_HINTS})""",
    ),
)
def discovery_report(spark, folder):
    return jobs.discovery_report(
        candidates(spark, folder), query_log(spark, folder), now=NOW, max_age_hours=MAX_AGE_HOURS
    )


@query(
    "source_preview_counts",
    with_views(
        ["posts"],
        f"SELECT source, count(*) AS fetched, count(*) FILTER (WHERE {ROLE_SQL} AND {FRESH_SQL}) AS filtered "
        "FROM posts GROUP BY source",
    ),
)
def source_preview_counts(spark, folder):
    rows = posts(spark, folder)
    kept = filters.role_allowed(filters.role_text()) & filters.is_fresh(rows, now=NOW, max_age_hours=MAX_AGE_HOURS)
    return aggregates.source_preview_counts(rows, kept)


@query(
    "safe_error_type",
    with_views(
        ["qlog"],
        "SELECT CASE WHEN status_code IS NOT NULL THEN 'Http429' WHEN error_name = 'Client Error!' THEN 'Client_Error_' "
        "ELSE error_name END AS error_type, count(*) AS errors FROM qlog WHERE NOT ok GROUP BY 1",
    ),
)
def safe_error_type(spark, folder):
    return aggregates.error_type_counts(query_log(spark, folder).filter("NOT ok"))


@query(
    "cycle_bucket",
    "SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS cycle, count(*) AS events FROM events GROUP BY 1",
)
def cycle_bucket(spark, folder):
    events = table(spark, folder, "events")
    return events.groupBy(dates.cycle_number(events, "ts").alias("cycle")).agg(F.count(F.lit(1)).alias("events"))


# ---------------------------------------------------------------- application decisions
_RETRY = "('created', 'queued', 'loading', 'profile_missing')"
DECISIONS = f"""
resumes AS (SELECT operator_user_id, min(update_id) AS resume_from FROM updates
  WHERE kind = 'resume' AND upload_reason IS NULL GROUP BY operator_user_id),
clicks AS (SELECT u.update_id, u.operator_user_id, u.vacancy_id, l.fingerprint AS known, l.url,
  CASE WHEN u.update_id > r.resume_from THEN u.outcome ELSE 'profile_missing' END AS outcome,
  CASE WHEN u.update_id > r.resume_from THEN u.outcome_error ELSE {lit(terms.NO_RESUME_ERROR)} END AS outcome_error
  FROM updates u LEFT JOIN resumes r USING (operator_user_id) LEFT JOIN ledger l ON u.vacancy_id = l.fingerprint
  WHERE kind = 'apply' AND u.operator_user_id IN (0, 1)),
settled AS (SELECT operator_user_id, vacancy_id, min(update_id) AS settled_at, arg_min(outcome, update_id) AS status,
  min_by(struct_pack(e := outcome_error), update_id).e AS error
  FROM clicks WHERE url IS NOT NULL AND outcome NOT IN {_RETRY} GROUP BY operator_user_id, vacancy_id),
after AS (SELECT c.*, s.settled_at, s.status, s.error, row_number() OVER (PARTITION BY operator_user_id, vacancy_id,
    c.update_id > s.settled_at ORDER BY update_id) AS place
  FROM clicks c LEFT JOIN settled s USING (operator_user_id, vacancy_id) WHERE url IS NOT NULL),
decisions AS (
  SELECT update_id, CASE WHEN kind = 'resume' AND upload_reason IS NULL THEN 'resume_updated' ELSE 'skipped' END
    AS decision, false AS processed, NULL AS status_after, NULL AS error_after, operator_user_id, vacancy_id
  FROM updates WHERE NOT (kind = 'apply' AND operator_user_id IN (0, 1))
  UNION ALL SELECT update_id, 'failed', false, CASE WHEN known IS NOT NULL THEN 'failed' END,
    CASE WHEN known IS NOT NULL THEN {lit(terms.NO_URL_ERROR)} END, operator_user_id, vacancy_id
  FROM clicks WHERE url IS NULL
  UNION ALL SELECT update_id, CASE WHEN settled_at IS NULL OR update_id <= settled_at THEN
      CASE WHEN outcome IN ('submitted', 'manual_required') THEN outcome ELSE 'failed' END
      WHEN status = 'submitting' AND place = 1 THEN 'manual_required' WHEN status = 'failed' THEN 'failed'
      ELSE 'skipped' END, settled_at IS NULL OR update_id <= settled_at,
    CASE WHEN settled_at IS NULL OR update_id <= settled_at THEN outcome WHEN status = 'submitting' THEN 'manual_required'
      ELSE status END,
    CASE WHEN settled_at IS NULL OR update_id <= settled_at THEN outcome_error
      WHEN status = 'submitting' THEN {lit(terms.INTERRUPTED_ERROR)} ELSE error END, operator_user_id, vacancy_id FROM after)"""


def decisions_sql(select: str) -> str:
    return with_views(["updates", "ledger"], "").rstrip() + "," + DECISIONS + "\n" + select


def _decisions(spark, folder):
    # short runs of update ids, so that the state does pass from run to run
    return applications.decide_updates(
        updates(spark, folder), ledger(spark, folder), operators=OPERATORS, run_length=40
    )


@query(
    "application_decisions",
    decisions_sql("SELECT update_id, decision, processed, status_after, error_after FROM decisions"),
)
def application_decisions(spark, folder):
    return _decisions(spark, folder).select("update_id", "decision", "processed", "status_after", "error_after")


TALLY_SQL = decisions_sql(
    "SELECT count(*) AS updates_seen, count(*) FILTER (WHERE processed) AS applications_processed, "
    + ", ".join(
        f"count(*) FILTER (WHERE decision = '{d}') AS {name}"
        for d, name in (
            ("submitted", "submitted"), ("manual_required", "manual_required"), ("failed", "failed"),
            ("skipped", "skipped"), ("resume_updated", "resumes_updated"),
        )
    )
    + " FROM decisions"
)


@query("queue_tally", TALLY_SQL)
def queue_tally(spark, folder):
    return applications.queue_tally(_decisions(spark, folder))


_REASONS = (
    "WHEN coalesce(last.e, '') = '' THEN NULL "
    + " ".join(f"WHEN contains(lower(last.e), {lit(marker)}) THEN {lit(told)}" for marker, told in terms.ERROR_REASONS)
    + f" ELSE {lit(terms.DEFAULT_ERROR_REASON)}"
)
FINAL_SQL = decisions_sql(
    "SELECT operator_user_id, vacancy_id, last.s AS status, last.e AS error, "
    + f"CASE {_REASONS} END AS public_reason FROM (SELECT operator_user_id, vacancy_id, "
    "max_by(struct_pack(s := status_after, e := error_after), update_id) AS last FROM decisions "
    "WHERE status_after IS NOT NULL GROUP BY operator_user_id, vacancy_id)"
)


def explained(statuses):
    """Final states with what the operator is told about the error."""
    return statuses.withColumn("public_reason", error_reason(F.col("error")))


@query("application_ledger", FINAL_SQL)
def application_ledger(spark, folder):
    return explained(jobs.application_ledger(updates(spark, folder), ledger(spark, folder), operators=OPERATORS))
