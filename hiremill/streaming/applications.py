"""The update feed and the application state machine as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hiremill.operators.applications import PAIR, decide_updates
from hiremill.sources.ledger import read_batches, write_batch

_STATUS = "operator_user_id bigint, vacancy_id string, status string, error string, update_id bigint"
_RESUME = "operator_user_id bigint, resume_from bigint"


def read_update_feed(
    spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 100
) -> DataFrame:
    """The feed, a file or a folder, as a stream; its checkpoint is the offset, which moves on after a batch is done."""
    # a file is no base path of partitions; a pattern that matches it alone has none
    either = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(either)


def application_batch(
    updates: DataFrame,
    batch_id: int,
    ledger: DataFrame,
    folder: str,
    *,
    operators: Sequence[int],
    default_resume: bool = False,
) -> None:
    """Decide one batch of updates from the state the earlier batches left.

    State is an append-only log with one row per pair that a batch touched, read only for
    the pairs of this batch.
    """
    spark = updates.sparkSession
    write_batch(updates, f"{folder}/updates", batch_id)
    updates = spark.read.schema(updates.schema).parquet(f"{folder}/updates/batch={batch_id}")
    # the ledger is reduced to the posts of this batch before anything is shuffled
    asked = updates.select(F.col("vacancy_id").alias("fingerprint"))
    ledger = ledger.join(asked, "fingerprint", "left_semi")
    log = read_batches(spark, f"{folder}/statuses", _STATUS, before=batch_id)
    touched = updates.filter(F.col("kind") == "apply").select(*PAIR).distinct()
    current = (
        log.join(touched, list(PAIR), "left_semi")
        .groupBy(*PAIR)
        .agg(F.max_by(F.struct("status", "error"), "update_id").alias("_last"))
        .select("operator_user_id", F.col("vacancy_id").alias("vacancy_fingerprint"), "_last.status", "_last.error")
    )
    resumes = read_batches(spark, f"{folder}/resumes", _RESUME, before=batch_id)
    decisions = decide_updates(
        updates,
        ledger,
        operators=operators,
        default_resume=default_resume,
        current=current,
        earlier_resumes=resumes.groupBy("operator_user_id").agg(F.min("resume_from").alias("resume_from")),
    )
    write_batch(decisions, f"{folder}/decisions", batch_id)
    decided = spark.read.schema(decisions.schema).parquet(f"{folder}/decisions/batch={batch_id}")
    changed = decided.filter(F.col("status_after").isNotNull())
    last = F.max_by(F.struct(F.col("status_after").alias("status"), F.col("error_after").alias("error")), "update_id")
    statuses = (
        changed.groupBy(*PAIR)
        .agg(last.alias("_last"), F.max("update_id").alias("update_id"))
        .select(*PAIR, "_last.status", "_last.error", "update_id")
    )
    write_batch(statuses, f"{folder}/statuses", batch_id)
    stored = decided.filter(F.col("decision") == "resume_updated")
    write_batch(
        stored.groupBy("operator_user_id").agg(F.min("update_id").alias("resume_from")),
        f"{folder}/resumes",
        batch_id,
    )


def stream_applications(
    updates: DataFrame,
    ledger: Callable[[], DataFrame],
    folder: str,
    *,
    operators: Sequence[int],
    default_resume: bool = False,
) -> StreamingQuery:
    """Drain the feed; every update gets one row in ``decisions``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        application_batch(
            batch, batch_id, ledger(), folder, operators=operators, default_resume=default_resume
        )

    return (
        updates.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/decisions").drop("batch")


def latest_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Status and error of every pair after all batches."""
    log = read_batches(spark, f"{folder}/statuses", _STATUS)
    last = log.groupBy(*PAIR).agg(F.max_by(F.struct("status", "error"), "update_id").alias("_last"))
    return last.select(*PAIR, "_last.status", "_last.error")
