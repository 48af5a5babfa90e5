"""Streaming queries: the given tables as file streams, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill.catalog.base import (
    MAX_AGE_HOURS,
    NOW,
    OPERATORS,
    documents,
    ledger,
    lit,
    posts_from_orders,
    query,
    table,
    updates,
    updates_from_events,
    with_views,
)
from hiremill.catalog.discovery import CAP
from hiremill.catalog.filters import ACCENTED, BELOW_SQL, FRESH_SQL, OFFER_2_SQL, ROLE_SQL, localized_texts
from hiremill.catalog.reports import FINAL_SQL, TALLY_SQL, decisions_sql, explained
from hiremill.catalog.texts import CARD_SQL
from hiremill.operators.dedupe import with_fingerprint
from hiremill.session import stored, work_folder
from hiremill.sources.ledger import write_batch
from hiremill.streaming import applications as application_stream
from hiremill.streaming import application_state, publish
from hiremill.streaming.localize import stream_localized as stream_localized_posts
from hiremill.streaming.localize import with_localized


BATCHES = 3
#: Rows of a file that a stream reads, about; a file has so many at least where a batch has several.
FILE_ROWS = 20_000
LEAST_FILE_ROWS = 1_000


def _stream(spark, folder, name):
    """The table as a stream of three batches: the rows of each remainder of its key, in files of their own."""
    rows = table(spark, folder, name)
    return _in_batches(spark, rows, F.pmod(F.col(rows.columns[0]), F.lit(BATCHES)), name)


def _in_batches(spark, rows, batch, name):
    """The rows as a stream, by the number of their batch; file times tell the order of batches."""
    target = work_folder(spark, f"stream-{name}")
    files = _files(rows, batch)
    for number in range(BATCHES):
        _land(rows.where(batch == number), files, target)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return application_stream.read_update_feed(spark, target, schema, files_per_batch=files)


def _files(rows, batch):
    """How many files each batch gets: the same number for all, so that a trigger of that many files is a batch."""
    counts = [r["count"] for r in rows.groupBy(batch.alias("batch")).count().collect()]
    return max(1, min(-(-max(counts, default=0) // FILE_ROWS), min(counts, default=0) // LEAST_FILE_ROWS))


def _land(rows, files, target):
    """The rows as so many more files in a folder, written side by side."""
    rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
    before = len(rows.sparkSession.read.parquet(target).inputFiles()) if _exists(rows.sparkSession, target) else 0
    rows.write.mode("append").parquet(target)
    landed = len(rows.sparkSession.read.parquet(target).inputFiles()) - before
    if landed != files:
        raise RuntimeError(f"{landed} files landed in {target}, {files} make a batch")


def _exists(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _stretch(rows, key, parts):
    """Which of several equal stretches of its key a row is in; ids that come in order stay in order."""
    last = rows.agg(F.max(key)).first()[0] or 0
    return F.floor(F.col(key) * parts / F.lit(last + 1))


def _events(spark, folder):
    """The events as a stream of three batches, in the order of their ids."""
    rows = table(spark, folder, "events")
    return _in_batches(spark, rows, _stretch(rows, "event_id", BATCHES), "events")


def _posts(spark, folder):
    return posts_from_orders(spark, folder, _stream(spark, folder, "orders"))


def _published(spark, folder, max_posts, posts=None):
    target = work_folder(spark, "publish")
    # the ledger of earlier polls comes before the first batch
    write_batch(ledger(spark, folder), f"{target}/published", -1)
    run = publish.stream_publish(
        _posts(spark, folder) if posts is None else posts, target, max_age_hours=MAX_AGE_HOURS, max_posts=max_posts,
        clock=lambda: NOW, interval_seconds=None,
    )
    run.awaitTermination()
    return target


def _batches_sql(select: str) -> str:
    """What each of the batches publishes, and what waits after it: chosen0, waiting0, chosen1 and so on."""
    steps = [
        f"allowed AS (SELECT *, {CARD_SQL.format(lit('—'))} AS card FROM prints WHERE {ROLE_SQL} AND {FRESH_SQL})",
        "waiting AS (SELECT * FROM allowed WHERE false)",
        "published AS (SELECT fingerprint FROM ledger)",
    ]
    waiting, published = "waiting", "published"
    for number in range(BATCHES):
        steps += [
            f"eligible{number} AS (SELECT * FROM (SELECT * FROM allowed WHERE k % {BATCHES} = {number} UNION ALL "
            f"SELECT * FROM {waiting}) WHERE fingerprint NOT IN (SELECT fingerprint FROM {published}) "
            "QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY source_rank, k) = 1)",
            f"chosen{number} AS (SELECT * FROM eligible{number} ORDER BY source_rank, k LIMIT {CAP})",
            f"waiting{number} AS (SELECT * FROM eligible{number} WHERE k NOT IN (SELECT k FROM chosen{number}))",
            f"published{number} AS (SELECT fingerprint FROM {published} UNION ALL SELECT fingerprint FROM chosen{number})",
        ]
        waiting, published = f"waiting{number}", f"published{number}"
    return with_views(["prints", "ledger"], "").rstrip() + ",\n" + ",\n".join(steps) + "\n" + select


@query(
    "stream_publish",
    _batches_sql(" UNION ALL ".join(f"SELECT fingerprint, k, source, title, card, {n} AS batch FROM chosen{n}" for n in range(BATCHES))),
)
def stream_publish(spark, folder):
    """Three polls under a cap: what one of them cannot publish comes before the new posts of the next."""
    target = _published(spark, folder, CAP)
    return publish.read_cards(spark, target).select("fingerprint", "k", "source", "title", "card", "batch")


@query("stream_pending", _batches_sql(f"SELECT fingerprint, k FROM waiting{BATCHES - 1}"))
def stream_pending(spark, folder):
    """What the capped stream keeps for its next batch."""
    target = _published(spark, folder, CAP)
    return with_fingerprint(publish.read_pending(spark, target)).select("fingerprint", "k")


@query(
    "stream_write_cards",
    with_views(
        ["prints"],
        f"SELECT fingerprint, arg_min(title, (k % {BATCHES}, k)) AS title, arg_min(source, (k % {BATCHES}, k)) AS source, "
        "first(url) AS url FROM prints GROUP BY fingerprint",
    ),
)
def stream_write_cards(spark, folder):
    target = work_folder(spark, "cards")
    publish.stream_cards(_posts(spark, folder), target, ["k"]).awaitTermination()
    return publish.read_published(spark, target).select("fingerprint", "title", "source", "url")


@query("stream_dedupe", with_views(["prints"], "SELECT DISTINCT fingerprint FROM prints"))
def stream_dedupe(spark, folder):
    target = work_folder(spark, "dedupe")
    publish.stream_dedupe(_posts(spark, folder), target, ["k"]).awaitTermination()
    return publish.read_published(spark, target).select("fingerprint")


# ---------------------------------------------------------------- localization inside the flow
_START = "2026-01-01 00:00:00"
_WAIT_MINUTES = 15
#: Offers of documents whose id leaves this remainder by 5 come after the wait is over.
_LATE = 3


def _seen_at(key):
    """Documents are seen a second apart in the order of batches, batches a day apart."""
    at = F.unix_seconds(F.lit(_START).cast("timestamp")) + F.pmod(key, F.lit(BATCHES)) * 86_400 + F.pmod(key, F.lit(40_000))
    return F.timestamp_seconds(at)


def _tick(rows, event_time):
    """A row without a key, far behind all others, that ends every wait."""
    nothing = [
        (F.lit("2027-01-01").cast("timestamp") if f.name == event_time else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in rows.schema.fields
    ]
    return rows.unionByName(rows.sparkSession.range(1).select(*nothing))


def localized_stream(spark, folder, keep_original=True):
    """Documents and the texts offered for them as two streams of three batches."""
    key = F.col("doc_id")
    docs = documents(spark, folder).select(key, F.col("text").alias("description"), _seen_at(key).alias("seen_at"))
    late = F.when(key % 5 == _LATE, F.expr("INTERVAL 16 MINUTES")).otherwise(F.expr("INTERVAL 1 MINUTE"))
    texts = localized_texts(spark, folder).withColumn("offered_at", _seen_at(key) + late)

    def stream(rows, event_time, name):
        batch = F.when(key.isNull(), BATCHES - 1).otherwise(F.pmod(key, F.lit(BATCHES)))
        return _in_batches(spark, _tick(rows, event_time), batch, name)

    return stream_localized_posts(
        stream(docs, "seen_at", "documents"), stream(texts, "offered_at", "texts"), "doc_id",
        wait=f"{_WAIT_MINUTES} minutes", keep_original=keep_original, **ACCENTED,
    )


def _drained(stream, spark, name):
    target = work_folder(spark, name)
    run = stream.writeStream.format("parquet").option("path", f"{target}/rows")
    run.option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/rows")


_NEEDED = f"trim(text) <> '' AND {BELOW_SQL.format('text')}"


@query(
    "stream_localized",
    f"SELECT doc_id, CASE WHEN {_NEEDED} AND doc_id % 5 <> {_LATE} THEN {OFFER_2_SQL} ELSE text END AS description FROM documents",
)
def stream_localized(spark, folder):
    """Each document once, in the text that came in time or as it was."""
    return with_localized(_drained(localized_stream(spark, folder), spark, "localized")).select("doc_id", "description")


@query(
    "stream_localized_strict",
    f"SELECT doc_id, CASE WHEN {_NEEDED} THEN {OFFER_2_SQL} ELSE text END AS description FROM documents "
    f"WHERE NOT ({_NEEDED}) OR doc_id % 5 <> {_LATE}",
)
def stream_localized_strict(spark, folder):
    """The same without the documents whose text did not come in time."""
    stream = localized_stream(spark, folder, keep_original=False)
    return with_localized(_drained(stream, spark, "localized-strict")).select("doc_id", "description")


@query("stream_dedupe_bounded", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_bounded(spark, folder):
    """Copies inside a watermark longer than the data: the same as a permanent memory."""
    target = work_folder(spark, "bounded")
    events = _events(spark, folder).select(
        "user_id", "event_type", F.concat_ws("|", "user_id", "event_type").alias("fingerprint"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    kept = publish.dedupe_within(events, "ts", "400 days")
    run = (
        kept.writeStream.format("parquet").option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{target}/rows").select("user_id", "event_type")


@query("stream_update_feed", "SELECT event_id, user_id, event_type FROM events")
def stream_update_feed(spark, folder):
    target = work_folder(spark, "feed")
    feed = _events(spark, folder).select("event_id", "user_id", "event_type")
    run = (
        feed.writeStream.format("parquet").option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{target}/rows")


@query(
    "stream_late_data",
    with_views(
        ["posts"],
        "SELECT k FROM posts WHERE published_at >= TIMESTAMP '1999-08-02 00:00:00'",
    ),
)
def stream_late_data(spark, folder):
    """Age is measured when a batch runs, so old posts are dropped whenever they arrive."""
    target = work_folder(spark, "late")
    publish.stream_fresh(
        _posts(spark, folder), target, max_age_hours=MAX_AGE_HOURS, clock=lambda: NOW, interval_seconds=None
    ).awaitTermination()
    return publish.read_fresh(spark, target).select("k")


def _applications(spark, folder):
    target = work_folder(spark, "applications")
    feed = updates_from_events(spark, folder, _events(spark, folder))
    application_stream.stream_applications(
        feed, lambda: ledger(spark, folder), target, operators=OPERATORS
    ).awaitTermination()
    return target


@query(
    "stream_application_decisions",
    decisions_sql("SELECT update_id, decision, processed, status_after, error_after FROM decisions"),
)
def stream_application_decisions(spark, folder):
    decided = application_stream.read_decisions(spark, _applications(spark, folder))
    return decided.select("update_id", "decision", "processed", "status_after", "error_after")


@query("stream_application_statuses", FINAL_SQL)
def stream_application_statuses(spark, folder):
    return explained(application_stream.latest_statuses(spark, _applications(spark, folder)))


def _polled(spark, folder):
    """The feed drained in two polls on keyed state, the second from the checkpoints of the first; their tallies."""
    target, landed = work_folder(spark, "polls"), work_folder(spark, "stream-updates")
    # the feed and the ledger are made once, not for every stretch and batch
    rows, published = stored(updates(spark, folder), "updates"), stored(ledger(spark, folder), "ledger")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    # four stretches, two for each poll
    stretch = _stretch(rows, "update_id", 4)
    files = _files(rows, stretch)
    application_state.use_state_store(spark)
    tallies = []
    for number in range(4):
        _land(rows.where(stretch == number), files, landed)
        if number % 2:
            tallies.append(application_state.poll_applications(
                application_stream.read_update_feed(spark, landed, schema, files_per_batch=files),
                lambda: published, target, operators=OPERATORS,
            ))
    return target, tallies


@query(
    "keyed_application_decisions",
    decisions_sql("SELECT update_id, decision, processed, status_after, error_after FROM decisions"),
)
def keyed_application_decisions(spark, folder):
    target, _ = _polled(spark, folder)
    decided = application_state.read_polled_decisions(spark, target)
    return decided.select("update_id", "decision", "processed", "status_after", "error_after")


@query("stream_queue_tally", TALLY_SQL)
def stream_queue_tally(spark, folder):
    """The tallies of both polls, observed on the way, summed."""
    _, tallies = _polled(spark, folder)
    names = ["updates_seen", "applications_processed", "submitted", "manual_required", "failed", "skipped", "resumes_updated"]
    rows = spark.createDataFrame([[t[n] for n in names] for t in tallies], ", ".join(f"{n} bigint" for n in names))
    return rows.agg(*[F.sum(n).alias(n) for n in names])
