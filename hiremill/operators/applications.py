"""The application ledger and the retry-safe state of every (operator, post) pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.identity import application_id
from hiremill.functions.urls import authority
from hiremill.operators.joins import request_to_post

PAIR = ("operator_user_id", "vacancy_id")
# updates of one pair are handled in runs of this many update ids
RUN_LENGTH = 100_000


def insert_applications(requests: DataFrame, ledger: DataFrame, existing: DataFrame) -> DataFrame:
    """New application rows. Malformed and unknown posts are dropped, known pairs are left alone.

    requests: operator_user_id, vacancy_id. Equal requests are merged before any join.
    """
    pairs = requests.select(*PAIR).distinct()
    known = existing.select("operator_user_id", F.col("vacancy_fingerprint").alias("vacancy_id"))
    fresh = request_to_post(pairs, ledger).join(known, list(PAIR), "left_anti")
    has_url = F.coalesce(F.col("vacancy_url"), F.lit("")) != ""
    return fresh.select(
        application_id(F.col("operator_user_id"), F.col("vacancy_id")).alias("application_id"),
        "operator_user_id",
        F.col("vacancy_id").alias("vacancy_fingerprint"),
        "vacancy_url",
        F.when(has_url, authority(F.col("vacancy_url"))).alias("site"),
        F.when(has_url, "created").otherwise("failed").alias("status"),
        F.when(~has_url, terms.NO_URL_ERROR).alias("error_description"),
    )


def update_application_status(applications: DataFrame, changes: DataFrame) -> DataFrame:
    """Applications after a change log; the last change wins, unknown ids change nothing.

    changes: application_id, seq, status, error.
    """
    last = changes.groupBy("application_id").agg(
        F.max_by(F.struct("status", "error"), "seq").alias("_change")
    )
    changed = F.col("_change").isNotNull()
    return (
        applications.join(last, "application_id", "left")
        .withColumn("status", F.when(changed, F.col("_change.status")).otherwise(F.col("status")))
        .withColumn(
            "error_description", F.when(changed, F.col("_change.error")).otherwise(F.col("error_description"))
        )
        .drop("_change")
    )


def valid_status(status: Column, known: Sequence[str] = terms.APPLICATION_STATUSES) -> Column:
    return F.coalesce(status.isin(*known), F.lit(False))


def worker_outcome(status: Column, error: Column, crashed: Column, submit_started: Column) -> Column:
    """Status and error a run leaves behind; a crash after the submission began is never retried."""
    crash = F.coalesce(crashed, F.lit(False))
    started = F.coalesce(submit_started, F.lit(False))
    return F.struct(
        F.when(crash, F.when(started, "manual_required").otherwise("failed")).otherwise(status).alias("status"),
        F.when(
            crash, F.when(started, terms.CRASH_AFTER_ERROR).otherwise(terms.CRASH_BEFORE_ERROR)
        ).otherwise(error).alias("error"),
    )


def resume_available_from(updates: DataFrame, accepted: Column) -> DataFrame:
    """Per operator, the first update that stored a resume."""
    return updates.filter(accepted).groupBy("operator_user_id").agg(F.min("update_id").alias("resume_from"))


def decide_clicks(
    clicks: DataFrame,
    current: DataFrame | None = None,
    *,
    retryable: Sequence[str] = terms.RETRYABLE_STATUSES,
    run_length: int = RUN_LENGTH,
) -> DataFrame:
    """What every application click does, given the clicks before it on the same pair.

    While the pair is in a retryable status each click runs the worker and takes its
    outcome. The first other outcome settles the pair: later clicks are skipped, except
    that a failed pair reports its failure again and a pair left at ``submitting`` becomes
    ``manual_required`` on the next click and is never submitted again.

    clicks: update_id, operator_user_id, vacancy_id, outcome, outcome_error (optional). current:
    the pair's status and error so far, if any. The result adds decision, processed, status_after
    and error_after, the error text that goes with the status.

    Only the settling click of a pair matters to the others, so a pair's clicks are first
    aggregated per run of ``run_length`` update ids and the state passes from run to run. A
    pair with any number of clicks is thereby spread over many tasks.
    """
    run = [*PAIR, "_run"]
    clicks = with_error(clicks, "outcome_error")
    clicks = clicks.withColumn("_run", F.floor(F.col("update_id") / run_length))
    in_run = Window.partitionBy(*run).orderBy("update_id")
    clicks = clicks.withColumn("_next", F.lead("update_id").over(in_run))

    settles = ~F.col("outcome").isin(*retryable)
    settle_at = F.when(settles, F.col("update_id"))
    runs = clicks.groupBy(*run).agg(
        F.min("update_id").alias("_first"),
        F.min_by(F.struct("update_id", "outcome", "outcome_error", "_next"), settle_at).alias("_settle"),
    )
    if current is None:
        runs = runs.withColumn("_before", F.lit(None).cast("string")).withColumn("_error", F.lit(None).cast("string"))
    else:
        held = with_error(current, "error").select(
            "operator_user_id", F.col("vacancy_fingerprint").alias("vacancy_id"), F.col("status").alias("_before"),
            F.col("error").alias("_error"),
        )
        runs = runs.join(held, list(PAIR), "left")
    by_pair = Window.partitionBy(*PAIR).orderBy("_run")
    runs = (
        runs.withColumn("_after", F.lead("_first").over(by_pair))
        .withColumn("_pair_first", F.first("_first").over(by_pair))
        .withColumn(
            "_settled",
            F.when(
                F.col("_settle").isNotNull(),
                F.struct(
                    F.col("_settle.update_id").alias("at"),
                    F.col("_settle.outcome").alias("status"),
                    F.col("_settle.outcome_error").alias("error"),
                    F.coalesce("_settle._next", "_after").alias("next"),
                ),
            ),
        )
        .withColumn(
            "_settled",
            F.first("_settled", ignorenulls=True).over(by_pair.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    # a pair settled before this batch: its first click here follows the settled status
    before = F.col("_before").isNotNull() & ~F.col("_before").isin(*retryable)
    state = runs.select(
        *run,
        F.when(
            before,
            F.struct(
                F.lit(-1).cast("bigint").alias("at"),
                F.col("_before").alias("status"),
                F.col("_error").alias("error"),
                F.col("_pair_first").alias("next"),
            ),
        )
        .otherwise(F.col("_settled"))
        .alias("_state"),
    )
    joined = clicks.join(state, run)
    late = F.col("_state").isNotNull() & (F.col("update_id") > F.col("_state.at"))
    resumed = (F.col("_state.status") == "submitting") & (F.col("update_id") == F.col("_state.next"))
    counted = F.when(F.col("outcome").isin("submitted", "manual_required"), F.col("outcome")).otherwise("failed")
    stopped = F.col("_state.status") == "submitting"
    interrupted = F.when(stopped, "manual_required").otherwise(F.col("_state.status"))
    error = F.when(stopped, terms.INTERRUPTED_ERROR).otherwise(F.col("_state.error"))
    return joined.select(
        "update_id",
        *PAIR,
        F.when(late & resumed, "manual_required")
        .when(late & (F.col("_state.status") == "failed"), "failed")
        .when(late, "skipped")
        .otherwise(counted)
        .alias("decision"),
        (~late).alias("processed"),
        F.when(late, interrupted).otherwise(F.col("outcome")).alias("status_after"),
        F.when(late, error).otherwise(F.col("outcome_error")).alias("error_after"),
    )


def with_error(df: DataFrame, name: str) -> DataFrame:
    """The table with the error column; one that has none knows no errors."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast("string"))


def route_updates(
    updates: DataFrame,
    ledger: DataFrame,
    *,
    operators: Sequence[int],
    default_resume: bool = False,
    earlier_resumes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Decisions that need no state, and the clicks that reach the worker of a pair.

    The first are uploads, other updates, and clicks on posts that are unknown or have no link. The clicks
    carry update_id, the pair, and the outcome they would leave behind, which is ``profile_missing`` as long
    as the operator has stored no resume.
    """
    updates = with_error(updates, "outcome_error")
    allowed = F.coalesce(F.col("operator_user_id").isin(*operators), F.lit(False))
    stored = (F.col("kind") == "resume") & allowed & F.col("upload_reason").isNull()
    applies = (F.col("kind") == "apply") & allowed

    other = updates.filter(~F.coalesce(applies, F.lit(False))).select(
        "update_id",
        *PAIR,
        F.when(stored, "resume_updated").otherwise("skipped").alias("decision"),
        F.lit(False).alias("processed"),
        F.lit(None).cast("string").alias("status_after"),
        F.lit(None).cast("string").alias("error_after"),
    )

    clicks = updates.filter(applies)
    # at most one row per listed operator, so its size is bounded by the setting
    resumes = resume_available_from(updates, stored)
    if earlier_resumes is not None:
        resumes = (
            resumes.unionByName(earlier_resumes.filter(allowed).select("operator_user_id", "resume_from"))
            .groupBy("operator_user_id")
            .agg(F.min("resume_from").alias("resume_from"))
        )
    clicks = clicks.join(resumes, "operator_user_id", "left")
    has_resume = F.lit(default_resume) | F.coalesce(F.col("update_id") > F.col("resume_from"), F.lit(False))
    clicks = clicks.withColumns(
        {
            "outcome": F.when(has_resume, F.col("outcome")).otherwise("profile_missing"),
            "outcome_error": F.when(has_resume, F.col("outcome_error")).otherwise(terms.NO_RESUME_ERROR),
        }
    )
    posts = ledger.select(
        F.col("fingerprint").alias("vacancy_id"), F.col("url").alias("_url"), F.lit(True).alias("_known")
    )
    met = clicks.select("update_id", *PAIR, "outcome", "outcome_error").join(posts, "vacancy_id", "left")
    linked = F.col("_known") & (F.coalesce(F.col("_url"), F.lit("")) != "")
    linked = F.coalesce(linked, F.lit(False))
    refused = met.filter(~linked).select(
        "update_id",
        *PAIR,
        F.lit("failed").alias("decision"),
        F.lit(False).alias("processed"),
        F.when(F.col("_known"), "failed").alias("status_after"),
        F.when(F.col("_known"), terms.NO_URL_ERROR).alias("error_after"),
    )
    return other.unionByName(refused), met.filter(linked).drop("_url", "_known")


def decide_updates(
    updates: DataFrame,
    ledger: DataFrame,
    *,
    operators: Sequence[int],
    default_resume: bool = False,
    current: DataFrame | None = None,
    earlier_resumes: DataFrame | None = None,
    run_length: int = RUN_LENGTH,
) -> DataFrame:
    """One decision per update of the feed: submitted, manual_required, failed, skipped or resume_updated.

    updates: update_id, operator_user_id, kind ('apply', 'resume' or other), vacancy_id,
    upload_reason (null accepts a resume), outcome (status the worker would leave behind),
    outcome_error (its error text, optional).
    """
    plain, clicks = route_updates(
        updates, ledger, operators=operators, default_resume=default_resume, earlier_resumes=earlier_resumes
    )
    return plain.unionByName(decide_clicks(clicks, current, run_length=run_length))


def final_statuses(decisions: DataFrame) -> DataFrame:
    """Status and error of every pair after its last update."""
    known = decisions.filter(F.col("status_after").isNotNull())
    last = F.max_by(F.struct(F.col("status_after").alias("status"), F.col("error_after").alias("error")), "update_id")
    return known.groupBy(*PAIR).agg(last.alias("_last")).select(*PAIR, "_last.status", "_last.error")


def tally_columns() -> list[Column]:
    """What a run over the feed counts."""

    def tally(decision: str) -> Column:
        return F.count_if(F.col("decision") == decision)

    return [
        F.count(F.lit(1)).alias("updates_seen"),
        F.count_if(F.col("processed")).alias("applications_processed"),
        tally("submitted").alias("submitted"),
        tally("manual_required").alias("manual_required"),
        tally("failed").alias("failed"),
        tally("skipped").alias("skipped"),
        tally("resume_updated").alias("resumes_updated"),
    ]


def queue_tally(decisions: DataFrame) -> DataFrame:
    """Counts of what a run over the feed did."""
    return decisions.agg(*tally_columns())
