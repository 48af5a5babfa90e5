"""Choice among localized descriptions. The texts themselves come from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.text import trim_text
from hiremill.operators.filters import localization_reason, needs_localization
from hiremill.operators.once import select_where


def localization_attempts(posts: DataFrame, texts: DataFrame, key: str, **script) -> DataFrame:
    """Every offered text of the posts that need one, normalized, with the reason it is refused.

    posts: key, description and any other columns. texts: key, model_rank, text.
    """
    wanted = posts.filter(needs_localization(F.col("description"), **script))
    return _with_reason(_offered(texts, key).join(wanted, key), F.lit(True), script)


def _offered(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, "model_rank", trim_text(F.col("text"), terms.MAX_LOCALIZED_CHARS).alias("localized"))


def _with_reason(attempts: DataFrame, translate: Column, script: dict) -> DataFrame:
    reason = localization_reason(F.col("description"), F.col("localized"), translate=translate, **script)
    return attempts.withColumn("reason", reason)


def localize_posts(
    posts: DataFrame, texts: DataFrame, key: str, *, keep_original: bool = True, **script
) -> DataFrame:
    """Posts with the accepted text of the best-ranked model.

    A post whose texts are all refused keeps its original description, or is left out
    when ``keep_original`` is off. Posts already in the target script are never changed.
    Posts meet their texts once, and the choice is made on the same partitioning.
    """
    # posts of one key are posts of their own, so each row carries a number
    marked = posts.withColumn("_needed", needs_localization(F.col("description"), **script)).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    tried = _with_reason(marked.join(_offered(texts, key), key, "left"), F.col("_needed"), script)
    usable = F.col("_needed") & F.col("localized").isNotNull() & F.col("reason").isNull()
    others = [c for c in posts.columns if c != key]
    chosen = tried.groupBy(key, "_row").agg(
        F.first(F.struct(*others, "_needed")).alias("_post"),
        F.min_by("localized", F.when(usable, F.col("model_rank"))).alias("_localized"),
    )
    if not keep_original:
        chosen = chosen.filter(F.col("_localized").isNotNull() | ~F.col("_post._needed"))
    description = F.coalesce("_localized", "_post.description").alias("description")
    return chosen.select(
        *[key if c == key else description if c == "description" else F.col(f"_post.{c}").alias(c) for c in posts.columns]
    )


def localization_errors(attempts: DataFrame, key: str) -> DataFrame:
    """Every refused text with its reason."""
    columns = {name: F.col(name) for name in (key, "model_rank", "reason")}
    return select_where(attempts, columns, lambda row: row["reason"].isNotNull())
