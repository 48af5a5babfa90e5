"""Localization inside the publishing flow: a stream of posts meets the stream of texts offered for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.functions.text import trim_text
from hiremill.operators.dedupe import hashable
from hiremill.operators.filters import localization_reason, needs_localization
from hiremill import terms

DEFAULT_WAIT = "15 minutes"


def stream_localized(
    posts: DataFrame,
    texts: DataFrame,
    key: str,
    *,
    seen_at: str = "seen_at",
    offered_at: str = "offered_at",
    wait: str = DEFAULT_WAIT,
    lateness: str = "0 seconds",
    keep_original: bool = True,
    **script,
) -> DataFrame:
    """The stream of posts with a column ``localized``: the accepted text of the best-ranked model, or null.

    posts: key, description, the event time ``seen_at`` and any other columns. texts: key, model_rank,
    text and the event time ``offered_at``. Posts already in the target script pass at once. The others
    wait in a stream-stream outer join for the texts offered within ``wait`` of them; when the watermark
    has passed that time, each comes out once, in its best text or, if none is accepted, in the original
    (or is left out, when ``keep_original`` is off). The state holds the posts and texts of one wait plus
    ``lateness``. Both streams must move on in event time, so a source that falls silent sends rows with a
    null key as ticks; those never come out.
    """
    marked = posts.filter(F.col(key).isNotNull()).withColumn(
        "_needed", needs_localization(F.col("description"), **script)
    )
    ready = marked.filter(~F.col("_needed")).withColumn("localized", F.lit(None).cast("string"))
    # ticks take the way of the waiting posts, so that they move its watermark
    needed = F.col(key).isNull() | needs_localization(F.col("description"), **script)
    waiting = posts.filter(needed).withColumn("_row", F.xxhash64(*hashable(posts))).withWatermark(seen_at, lateness)
    offered = texts.select(
        F.struct(F.col(key).alias("k")).alias("_key"), F.col("model_rank").alias("_model_rank"), F.col(offered_at).alias("_offered_at"),
        trim_text(F.col("text"), terms.MAX_LOCALIZED_CHARS).alias("_text"),
    ).withWatermark("_offered_at", lateness)
    # the key is wrapped: a plain one would let Spark drop the ticks before they move the watermark
    met = waiting.join(
        offered,
        (F.struct(F.col(key).alias("k")) == F.col("_key"))
        & (F.col("_offered_at") >= F.col(seen_at))
        & (F.col("_offered_at") <= F.col(seen_at) + F.expr(f"INTERVAL {wait}")),
        "leftOuter",
    ).drop("_key", "_offered_at")
    reason = localization_reason(F.col("description"), F.col("_text"), translate=F.lit(True), **script)
    tried = met.withColumn("_rank", F.when(F.col("_text").isNotNull() & reason.isNull(), F.col("_model_rank")))
    others = [c for c in posts.columns if c != seen_at]
    chosen = (
        tried.groupBy(seen_at, "_row")
        .agg(F.first(F.struct(*others)).alias("_post"), F.min_by("_text", "_rank").alias("localized"))
        .filter(F.col(f"_post.{key}").isNotNull())
    )
    if not keep_original:
        chosen = chosen.filter(F.col("localized").isNotNull())
    columns = [F.col(c) if c == seen_at else F.col(f"_post.{c}").alias(c) for c in posts.columns]
    return ready.select(*posts.columns, "localized").unionByName(chosen.select(*columns, "localized"))


def with_localized(posts: DataFrame) -> DataFrame:
    """The posts with the localized description in place of the original, where there is one."""
    if "localized" not in posts.columns:
        return posts
    return posts.withColumn("description", F.coalesce("localized", "description")).drop("localized")
