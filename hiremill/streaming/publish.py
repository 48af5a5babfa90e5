"""Publishing as a stream.

Each micro-batch writes folders named after its id. A batch that is run again after a
failure replaces its own folders and reads only those of earlier batches, so it comes to
the same result. Closed batches of the ledger and of the cards are merged into runs, and what
a batch needed for itself alone goes with the next one, so folders do not grow with the age of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hiremill import schemas
from hiremill.operators.dedupe import first_wins, with_fingerprint
from hiremill.operators.filters import filter_fresh
from hiremill.operators.ordering import publish_cap
from hiremill.plans.jobs import allowed_posts, with_card
from hiremill.sources import runs
from hiremill.sources.ledger import LEDGER_COLUMNS, read_batches, schema_of, write_batch
from hiremill.streaming.localize import with_localized

DEFAULT_INTERVAL_SECONDS = 900


def _clock() -> datetime:
    return datetime.now(UTC)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, interval_seconds: int | None
) -> StreamingQuery | None:
    """Run once over what has arrived (``None``) or every interval; zero or less disables the stream.

    An interval without new posts is a batch as well: posts beyond the cap wait for it.
    """
    if interval_seconds is not None and interval_seconds <= 0:
        return None
    if interval_seconds is not None:
        stream = stream.unionByName(_ticks(stream))
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
    if interval_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_seconds} seconds").start()


def _ticks(stream: DataFrame) -> DataFrame:
    """A stream of no rows that moves on with the clock."""
    clock = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    return clock.where(F.col("value") < 0).select(*nothing)


def _stored(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The batch as written, so that everything derived from it agrees."""
    write_batch(df, path, batch_id)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={batch_id}")


def _unseen(posts: DataFrame, folder: str, batch_id: int, order: Sequence[str]) -> DataFrame:
    """Posts with fingerprints that are new to the ledger of earlier batches, each once."""
    unique = first_wins(posts, ["fingerprint"], [F.col(c) for c in order])
    stored = _stored(unique, f"{folder}/unique", batch_id)
    return _stored(_without_seen(stored, folder, batch_id), f"{folder}/eligible", batch_id)


def _without_seen(posts: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """A small stored table of posts without those that the ledger holds; of its runs only some buckets are read."""
    met = runs.keys_met(posts, "fingerprint", f"{folder}/published", schemas.PUBLISHED, before)
    return posts.join(met, "fingerprint", "left_anti")


def _tidy(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Merge closed batches; forget what earlier batches needed for themselves alone. A batch run again finds its own."""
    runs.compact(spark, f"{folder}/published", schemas.PUBLISHED, "fingerprint", batch_id)
    for name in ("unique", "eligible"):
        runs.delete(spark, f"{folder}/{name}/batch={batch_id - 1}")
    runs.delete(spark, f"{folder}/pending/batch={batch_id - 2}")


def publish_batch(
    posts: DataFrame,
    batch_id: int,
    folder: str,
    *,
    now: datetime,
    max_age_hours: int,
    max_posts: int,
    order: Sequence[str],
    require_published_at: bool = False,
) -> None:
    """Publish one batch. Eligible posts beyond the cap wait in ``pending`` and join the next batch."""
    spark = posts.sparkSession
    schema = _schema(posts)
    waiting = read_batches(spark, f"{folder}/pending", schema, before=batch_id)
    waiting = waiting.filter(F.col("batch") == batch_id - 1).select(*posts.columns)
    allowed = allowed_posts(
        posts.unionByName(waiting), now=now, max_age_hours=max_age_hours, require_published_at=require_published_at
    )
    eligible = _unseen(allowed, folder, batch_id, order)
    # delivery comes before the ledger entry, so a crash repeats a card and never loses one;
    # the fingerprint is that of the original, whatever text the card shows
    chosen = with_localized(publish_cap(eligible, max_posts, order))
    cards = _stored(with_card(chosen), f"{folder}/cards", batch_id)
    write_batch(cards.select(*LEDGER_COLUMNS), f"{folder}/published", batch_id)
    rest = eligible.join(cards.select("fingerprint"), "fingerprint", "left_anti")
    write_batch(rest.select(*posts.columns), f"{folder}/pending", batch_id)
    _tidy(spark, folder, batch_id)
    runs.compact(spark, f"{folder}/cards", _schema(cards), "fingerprint", batch_id)


def stream_publish(
    posts: DataFrame,
    folder: str,
    *,
    max_age_hours: int,
    max_posts: int,
    order: Sequence[str] = ("source_rank", "position"),
    clock: Callable[[], datetime] = _clock,
    interval_seconds: int | None = DEFAULT_INTERVAL_SECONDS,
    require_published_at: bool = False,
) -> StreamingQuery | None:
    """Poll the stream of posts; the age limit is measured at the time of each batch.

    Posts with a column ``localized`` (see ``streaming.localize``) are published with that text.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        publish_batch(
            batch,
            batch_id,
            folder,
            now=clock(),
            max_age_hours=max_age_hours,
            max_posts=max_posts,
            order=order,
            require_published_at=require_published_at,
        )

    return _start(posts, handle, folder, interval_seconds)


def stream_cards(posts: DataFrame, folder: str, order: Sequence[str], interval_seconds: int | None = None):
    """Sink for posts that need no policy: unseen posts become cards and ledger rows."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = _unseen(with_fingerprint(batch), folder, batch_id, order)
        cards = _stored(with_card(with_localized(fresh)), f"{folder}/cards", batch_id)
        write_batch(cards.select(*LEDGER_COLUMNS), f"{folder}/published", batch_id)
        _tidy(batch.sparkSession, folder, batch_id)
        runs.compact(batch.sparkSession, f"{folder}/cards", _schema(cards), "fingerprint", batch_id)

    return _start(posts, handle, folder, interval_seconds)


def stream_dedupe(posts: DataFrame, folder: str, order: Sequence[str], interval_seconds: int | None = None):
    """Permanent memory: a fingerprint passes once, however late its next copy comes."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = _unseen(with_fingerprint(batch), folder, batch_id, order)
        write_batch(fresh.select(*LEDGER_COLUMNS), f"{folder}/published", batch_id)
        _tidy(batch.sparkSession, folder, batch_id)

    return _start(posts, handle, folder, interval_seconds)


def stream_fresh(
    posts: DataFrame,
    folder: str,
    *,
    max_age_hours: int,
    clock: Callable[[], datetime] = _clock,
    interval_seconds: int | None = DEFAULT_INTERVAL_SECONDS,
    require_published_at: bool = True,
) -> StreamingQuery | None:
    """Posts young enough at the time their batch runs."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = filter_fresh(
            batch, now=clock(), max_age_hours=max_age_hours, require_published_at=require_published_at
        )
        write_batch(fresh, f"{folder}/fresh", batch_id)

    return _start(posts, handle, folder, interval_seconds)


def read_fresh(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/fresh").drop("batch")


def dedupe_within(posts: DataFrame, event_time: str, max_age: str) -> DataFrame:
    """Bounded memory: copies inside the age limit are dropped, state older than it is forgotten."""
    return posts.withWatermark(event_time, max_age).dropDuplicatesWithinWatermark(["fingerprint"])


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    return read_batches(spark, f"{folder}/published")


def read_cards(spark: SparkSession, folder: str) -> DataFrame:
    return read_batches(spark, f"{folder}/cards", schema_of(spark, f"{folder}/cards"))


def read_pending(spark: SparkSession, folder: str, batch_id: int | None = None) -> DataFrame:
    """What waits after a batch, the last one unless another is named."""
    if batch_id is None:
        batch_id = max(p.last for p in runs.parts_of(spark, f"{folder}/pending"))
    return spark.read.parquet(f"{folder}/pending/batch={batch_id}")


def publish_pending(
    spark: SparkSession,
    folder: str,
    *,
    now: datetime,
    max_age_hours: int,
    max_posts: int,
    order: Sequence[str] = ("source_rank", "position"),
    require_published_at: bool = False,
) -> bool:
    """One poll without new input: the next posts beyond the cap. False if none is left.

    It belongs between runs of a stream that is drained; one that runs at intervals does so itself. Its folders have numbers below those of the stream's
    batches, so neither replaces the other, and the ledger tells the next run what it published.
    """
    waiting = allowed_posts(
        read_pending(spark, folder), now=now, max_age_hours=max_age_hours, require_published_at=require_published_at
    )
    number = min([-1, *(p.first for p in runs.parts_of(spark, f"{folder}/published"))]) - 1
    unique = _stored(first_wins(waiting, ["fingerprint"], [F.col(c) for c in order]), f"{folder}/unique", number)
    chosen = with_localized(publish_cap(_without_seen(unique, folder), max_posts, order))
    cards = _stored(with_card(chosen), f"{folder}/cards", number)
    write_batch(cards.select(*LEDGER_COLUMNS), f"{folder}/published", number)
    return not cards.isEmpty()
