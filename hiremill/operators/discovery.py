"""Planning of discovery: quotas, rotation and provider fallback."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.operators.dedupe import drop_seen, first_n, first_wins, new_posts, ties
from hiremill.session import stored

Intent = tuple[int, str, str, str]


def fair_quota(intents: DataFrame, total: int, by: Sequence[str]) -> DataFrame:
    """Quota of every intent: the total split evenly, the remainder to the first ones.

    ``by`` names one search profile (a cycle, an owner); its intents are few.
    """
    total = max(total, 0)
    group = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(group)
    place = F.row_number().over(group.orderBy("intent_pos"))
    quota = F.floor(F.lit(total) / n) + F.when(place <= F.lit(total) % n, 1).otherwise(0)
    return intents.withColumn("quota", quota.cast("int"))


def take_quota(
    candidates: DataFrame, quotas: DataFrame, keys: Sequence[str], order: Sequence[Column], total: int
) -> DataFrame:
    """The first rows of every intent, as many as its quota. No quota exceeds ``total``."""
    head = first_n(candidates, keys, order, max(total, 0), rank="_rank")
    kept = head.join(quotas.select(*keys, "quota"), list(keys), "inner").filter(F.col("_rank") <= F.col("quota"))
    return kept.drop("_rank")


def rotate_intents(
    cycles: DataFrame,
    max_intents: int = terms.INTENTS_PER_CYCLE,
    intents: Sequence[Intent] | None = None,
    cycle: str = "cycle",
) -> DataFrame:
    """The window of intents each cycle searches, in search order (``slot`` counts from 1).

    The profile is a parameter of a few rows, so each cycle picks its entries from a literal.
    """
    intents = terms.default_intents() if intents is None else intents
    n = len(intents)
    k = min(max(max_intents, 0), n)
    if not k:
        empty = "0 AS slot, 0 AS intent_pos, '' AS family, '' AS language, '' AS query"
        return cycles.select(cycle, *[F.expr(e) for e in empty.split(", ")]).limit(0)
    profile = F.array(
        *[
            F.struct(
                F.lit(pos).alias("intent_pos"), F.lit(family).alias("family"),
                F.lit(language).alias("language"), F.lit(query).alias("query"),
            )
            for pos, family, language, query in intents
        ]
    )
    start = F.greatest(F.col(cycle), F.lit(0)) * k
    slots = cycles.select(cycle, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_slot"))
    place = F.pmod(start + F.col("_slot"), F.lit(n)).cast("int")
    picked = slots.select(cycle, (F.col("_slot") + 1).alias("slot"), F.element_at(profile, place + 1).alias("_i"))
    return picked.select(cycle, "slot", "_i.intent_pos", "_i.family", "_i.language", "_i.query")


def default_or_custom_intents(raw: DataFrame, owner: str, query: str = "raw_query") -> DataFrame:
    """Queries of every owner's ``a || b`` text in order; a blank text gives the built-in profile."""
    from hiremill.functions.extract import split_queries

    custom = F.transform(
        split_queries(F.col(query)),
        lambda q, i: F.struct(
            (i + 1).alias("intent_pos"),
            F.concat(F.lit("custom-"), (i + 1).cast("string")).alias("family"),
            F.lit("custom").alias("language"),
            q.alias("query"),
        ),
    )
    profile = F.array(
        *[
            F.struct(
                F.lit(pos).alias("intent_pos"), F.lit(family).alias("family"),
                F.lit(language).alias("language"), F.lit(text).alias("query"),
            )
            for pos, family, language, text in terms.default_intents()
        ]
    )
    picked = raw.select(owner, F.explode(F.when(F.size(custom) > 0, custom).otherwise(profile)).alias("_i"))
    return picked.select(owner, "_i.intent_pos", "_i.family", "_i.language", "_i.query")


def first_provider_with_news(candidates: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per cycle and intent, the unseen URLs of the first provider that brought any.

    Each intent depends on what the earlier ones of its cycle accepted, so a cycle is
    folded in order. A query returns at most the quota of its intent, so a cycle has at most
    its total quota times the number of providers; cycles run in parallel.

    candidates: cycle, intent_pos, provider_rank, provider, position, url and any others.
    quotas: cycle, intent_pos, quota. An intent without a quota brings nothing.
    """
    columns = candidates.columns
    query = ["cycle", "intent_pos", "provider_rank"]
    order = [F.col("position"), F.col("url"), F.col("provider")]
    hits = first_wins(candidates, [*query, "url"], [*order, *ties(candidates)])
    limited = hits.join(quotas.select("cycle", "intent_pos", "quota"), ["cycle", "intent_pos"])
    place = F.row_number().over(Window.partitionBy(*query).orderBy(*order))
    answers = limited.withColumn("_place", place).filter(F.col("_place") <= F.col("quota")).select(*columns)

    def fold(cycle: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept = []
        for _, intent in cycle.sort_values(["intent_pos", "provider_rank", "position", "url"]).groupby("intent_pos"):
            for _, answer in intent.groupby("provider_rank"):
                news = answer[~answer["url"].isin(seen)]
                if len(news):
                    seen.update(news["url"])
                    kept.append(news)
                    break
        return pd.concat(kept) if kept else cycle.head(0)

    return answers.groupBy("cycle").applyInPandas(fold, answers.schema)


def cap_then_dedupe(posts: DataFrame, ledger: DataFrame, max_posts: int) -> DataFrame:
    """The one-shot cap: each source is cut to what is left of the cap, then deduplicated.

    Already published posts use up a source's share, and the share of the next one depends on what the
    earlier ones really published. All sources are settled at once, in rounds: from the shares of a round
    follows what each source publishes, a fingerprint going to the first source that has it within its
    share, and from that the shares of the next round. What the first source publishes is right after the
    first round, and each round settles at least one more source that matters; in most cases all after
    two or three. Only the first ``max_posts`` rows of a source can matter.

    Columns needed: source_rank, position, fingerprint; zero or less means no cap.
    """
    order = [F.col("position"), F.col("fingerprint")]
    if max_posts <= 0:
        return new_posts(posts, ledger, [F.col("source_rank"), *order])
    heads = first_n(posts, ["source_rank"], [*order, *ties(posts)], max_posts, rank="_place")
    heads = stored(heads, "one-shot-heads")
    names = ["source_rank", "_place", "fingerprint"]
    unseen = drop_seen(heads.select(*names), ledger)
    unseen = stored(unseen, "one-shot-unseen")
    shares = heads.select("source_rank").distinct().withColumn("share", F.lit(max_posts).cast("long"))
    state, before = None, object()
    while state != before:
        within = unseen.join(shares, "source_rank").where(F.col("_place") <= F.col("share"))
        firsts = within.groupBy("fingerprint").agg(F.min(F.struct("source_rank", "_place")).alias("_first"))
        firsts = stored(firsts, "one-shot-firsts")
        published = firsts.groupBy(F.col("_first.source_rank").alias("source_rank")).agg(F.count(F.lit(1)).alias("n"))
        # one row for each source stands in this window
        earlier = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
        left = F.greatest(F.lit(max_posts) - F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0)), F.lit(0))
        shares = shares.select("source_rank").join(published, "source_rank", "left").select("source_rank", left.alias("share"))
        shares = stored(shares, "one-shot-shares")
        before, state = state, shares.agg(F.sum(F.xxhash64("source_rank", "share").cast("decimal(38,0)"))).first()[0]
    chosen = firsts.select("_first.source_rank", "_first._place")
    return heads.join(chosen, ["source_rank", "_place"], "left_semi").drop("_place")
