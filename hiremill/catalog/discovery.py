"""Queries of windows, caps, quotas, rotation and priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill import terms
from hiremill.catalog.base import (
    CUTOFF_SQL,
    MAX_AGE_HOURS,
    NOW,
    candidates,
    cycles,
    ledger,
    lit,
    posts,
    query,
    with_views,
)
from hiremill.catalog.filters import FRESH_SQL, ROLE_SQL
from hiremill.catalog.texts import CARD_SQL
from hiremill.operators import discovery, filters, joins, ordering
from hiremill.operators.dedupe import distinct_urls, first_n, first_wins, with_fingerprint
from hiremill.plans import jobs

CAP = 200
_INTENTS = ", ".join(
    f"({pos}, {lit(family)}, {lit(language)}, {lit(text)})" for pos, family, language, text in terms.default_intents()
)
_INTENT_TABLE = f"(VALUES {_INTENTS}) AS i(intent_pos, family, language, query)"


# ---------------------------------------------------------------- first wins, caps
@query(
    "first_wins",
    with_views(
        ["prints"],
        "SELECT fingerprint, k, title FROM prints QUALIFY row_number() OVER "
        "(PARTITION BY fingerprint ORDER BY source_rank, k) = 1",
    ),
)
def first_of_each(spark, folder):
    rows = with_fingerprint(posts(spark, folder))
    return first_wins(rows, ["fingerprint"], [F.col("source_rank"), F.col("k")]).select("fingerprint", "k", "title")


@query(
    "per_source_head",
    with_views(
        ["posts"],
        f"SELECT k, source, title FROM posts WHERE {ROLE_SQL} "
        "QUALIFY row_number() OVER (PARTITION BY source ORDER BY k) <= 5",
    ),
)
def per_source_head(spark, folder):
    rows = filters.filter_role_policy(posts(spark, folder))
    return first_n(rows, ["source"], [F.col("k")], 5).select("k", "source", "title")


@query(
    "per_source_long_head",
    with_views(
        ["posts"],
        "SELECT k, source FROM posts QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC) <= 1500",
    ),
)
def per_source_long_head(spark, folder):
    return first_n(posts(spark, folder), ["source"], [F.col("k").desc()], 1500).select("k", "source")


_ELIGIBLE = (
    f"SELECT *, {CARD_SQL.format(lit('—'))} AS card FROM prints WHERE {ROLE_SQL} AND {FRESH_SQL} "
    "AND fingerprint NOT IN (SELECT fingerprint FROM ledger) "
    "QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY source_rank, k) = 1"
)
FLAGSHIP_SQL = with_views(
    ["prints", "ledger"],
    f"SELECT fingerprint, k, source, title, card FROM ({_ELIGIBLE}) ORDER BY source_rank, k LIMIT {CAP}",
)
ELIGIBLE_SQL = with_views(["prints", "ledger"], f"SELECT fingerprint, k, source, title, card FROM ({_ELIGIBLE})")


@query("publishable_posts", FLAGSHIP_SQL)
def publishable_posts(spark, folder):
    """The flagship: what one poll publishes."""
    chosen = jobs.publishable_posts(
        posts(spark, folder), ledger(spark, folder), now=NOW, max_age_hours=MAX_AGE_HOURS, max_posts=CAP
    )
    return chosen.select("fingerprint", "k", "source", "title", "card")


@query("publish_uncapped", ELIGIBLE_SQL)
def publish_uncapped(spark, folder):
    chosen = jobs.publishable_posts(
        posts(spark, folder), ledger(spark, folder), now=NOW, max_age_hours=MAX_AGE_HOURS, max_posts=0
    )
    return chosen.select("fingerprint", "k", "source", "title", "card")


def _one_shot_sql(cap: int) -> str:
    """Sources in order; each takes what is left of the cap before duplicates are dropped."""
    steps = [
        f"kept AS (SELECT * FROM prints WHERE {ROLE_SQL} AND {FRESH_SQL})",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY k) AS place FROM kept)",
        "done0 AS (SELECT fingerprint, k FROM ranked WHERE false)",
    ]
    for rank in range(3):
        steps.append(
            f"done{rank + 1} AS (SELECT * FROM done{rank} UNION ALL SELECT fingerprint, min(k) FROM ranked "
            f"WHERE source_rank = {rank} AND place <= {cap} - (SELECT count(*) FROM done{rank}) "
            f"AND fingerprint NOT IN (SELECT fingerprint FROM ledger) "
            f"AND fingerprint NOT IN (SELECT fingerprint FROM done{rank}) GROUP BY fingerprint)"
        )
    views = with_views(["prints", "ledger"], "")
    return f"{views.rstrip()},\n" + ",\n".join(steps) + "\nSELECT fingerprint, k FROM done3"


@query("publish_one_shot", _one_shot_sql(400))
def publish_one_shot(spark, folder):
    chosen = jobs.publishable_one_shot(
        posts(spark, folder), ledger(spark, folder), now=NOW, max_age_hours=MAX_AGE_HOURS, max_posts=400
    )
    return chosen.select("fingerprint", "k")


@query(
    "publish_cap",
    with_views(["posts"], "SELECT k, source_rank FROM posts ORDER BY source_rank, k LIMIT 777"),
)
def publish_cap(spark, folder):
    return ordering.publish_cap(posts(spark, folder), 777).select("k", "source_rank")


# ---------------------------------------------------------------- quotas and rotation
_QUOTA_SQL = (
    "SELECT cycle, intent_pos, 10 // n + CASE WHEN place <= 10 % n THEN 1 ELSE 0 END AS quota FROM "
    "(SELECT cycle, intent_pos, count(*) OVER (PARTITION BY cycle) AS n, "
    "row_number() OVER (PARTITION BY cycle ORDER BY intent_pos) AS place FROM asked)"
)


def _asked(spark, folder):
    """Intents of every provider: the query families it answered."""
    found = candidates(spark, folder)
    return found.select(
        F.col("provider").alias("cycle"), F.expr("CAST(substring(family, 2) AS INT) + 1").alias("intent_pos")
    ).distinct()


_ASKED = "asked AS (SELECT DISTINCT provider AS cycle, CAST(substr(family, 2) AS INTEGER) + 1 AS intent_pos FROM cands)"


@query("fair_quota", with_views(["cands"], "").rstrip() + f",\n{_ASKED}\n{_QUOTA_SQL}")
def fair_quota(spark, folder):
    return discovery.fair_quota(_asked(spark, folder), 10, ["cycle"]).select("cycle", "intent_pos", "quota")


@query(
    "take_quota",
    with_views(["cands"], "").rstrip()
    + f",\n{_ASKED}, quotas AS ({_QUOTA_SQL})\n"
    "SELECT c.cycle, c.intent_pos, position FROM (SELECT provider AS cycle, CAST(substr(family, 2) AS INTEGER) + 1 "
    "AS intent_pos, position, row_number() OVER (PARTITION BY provider, family ORDER BY position) AS place FROM cands) c "
    "JOIN quotas USING (cycle, intent_pos) WHERE place <= quota",
)
def take_quota(spark, folder):
    quotas = discovery.fair_quota(_asked(spark, folder), 10, ["cycle"])
    found = candidates(spark, folder).selectExpr(
        "provider AS cycle", "CAST(substring(family, 2) AS INT) + 1 AS intent_pos", "position"
    )
    return discovery.take_quota(found, quotas, ["cycle", "intent_pos"], [F.col("position")], 10).select(
        "cycle", "intent_pos", "position"
    )


@query(
    "rotate_intents",
    with_views(
        ["cycles"],
        f"SELECT cycle, slot, i.intent_pos, family, language, query FROM (SELECT cycle, unnest(range(6)) + 1 AS slot "
        f"FROM cycles) JOIN {_INTENT_TABLE} ON i.intent_pos = (cycle * 6 + slot - 1) % 24 + 1",
    ),
)
def rotate_intents(spark, folder):
    return discovery.rotate_intents(cycles(spark, folder))


@query(
    "intent_quota_zip",
    with_views(
        ["cycles"],
        f"SELECT cycle, slot, family, language, CASE WHEN slot <= 2 THEN 4 ELSE 3 END AS quota FROM "
        f"(SELECT cycle, unnest(range(6)) + 1 AS slot FROM cycles) JOIN {_INTENT_TABLE} "
        "ON i.intent_pos = (cycle * 6 + slot - 1) % 24 + 1",
    ),
)
def intent_quota_zip(spark, folder):
    intents = discovery.rotate_intents(cycles(spark, folder))
    slots = intents.select("cycle", F.col("slot").alias("intent_pos"))
    quotas = discovery.fair_quota(slots, 20, ["cycle"]).withColumnRenamed("intent_pos", "slot")
    return joins.intent_quota_zip(intents, quotas, ["cycle", "slot"]).select(
        "cycle", "slot", "family", "language", "quota"
    )


@query(
    "discovery_plan",
    with_views(
        ["cycles"],
        f"SELECT cycle, slot AS intent_pos, family, language, query, CASE WHEN slot <= 4 THEN 17 ELSE 16 END AS quota "
        f"FROM (SELECT cycle, unnest(range(6)) + 1 AS slot FROM cycles) JOIN {_INTENT_TABLE} "
        "ON i.intent_pos = (cycle * 6 + slot - 1) % 24 + 1",
    ),
)
def discovery_plan(spark, folder):
    return jobs.discovery_plan(cycles(spark, folder), total=100)


_RAW_QUERY = "CASE WHEN k % 50 = 0 THEN ' || ' ELSE concat(' ', title, ' || ', company, '||  || ', location, ' ') END"


@query(
    "split_intents",
    with_views(
        ["posts"],
        f"""SELECT k, i AS intent_pos, concat('custom-', CAST(i AS VARCHAR)) AS family, 'custom' AS language, q AS query
FROM (SELECT k, generate_subscripts(l, 1) AS i, unnest(l) AS q FROM (SELECT k, list_filter(list_transform(
  string_split({_RAW_QUERY}, '||'), lambda x: trim(x)), lambda x: x <> '') AS l FROM posts))
UNION ALL SELECT k, intent_pos, family, language, query FROM posts JOIN {_INTENT_TABLE} ON k % 50 = 0""",
    ),
)
def split_intents(spark, folder):
    raw = posts(spark, folder).selectExpr("k", f"{_RAW_QUERY} AS raw_query")
    return discovery.default_or_custom_intents(raw, "k")


_NEWS = (
    "asked AS (SELECT k // 600 AS cycle, k % 8 + 1 AS intent_pos, source_rank AS provider_rank, source AS provider, "
    "k AS position, concat('u', CAST(k * 7 % 40 AS VARCHAR)) AS url FROM posts),\n"
    "hits AS (SELECT * FROM asked QUALIFY row_number() OVER "
    "(PARTITION BY cycle, intent_pos, provider_rank, url ORDER BY position) = 1),\n"
    "answers AS (SELECT * FROM hits QUALIFY row_number() OVER "
    "(PARTITION BY cycle, intent_pos, provider_rank ORDER BY position) <= 13 - intent_pos),\n"
    "acc0 AS (SELECT cycle, intent_pos, provider_rank, position, url FROM answers WHERE false)"
)


def _news_sql(last: int = 8, quota: str = "13 - intent_pos") -> str:
    steps = []
    for intent in range(1, last + 1):
        news = (
            f"SELECT a.cycle, a.intent_pos, a.provider_rank, a.position, a.url FROM answers a LEFT JOIN acc{intent - 1} s "
            f"ON a.cycle = s.cycle AND a.url = s.url WHERE a.intent_pos = {intent} AND s.url IS NULL"
        )
        steps.append(
            f"acc{intent} AS (SELECT * FROM acc{intent - 1} UNION ALL (SELECT * FROM ({news}) "
            "QUALIFY provider_rank = min(provider_rank) OVER (PARTITION BY cycle)))"
        )
    answers = _NEWS.replace("13 - intent_pos", quota)
    return with_views(["posts"], "").rstrip() + f",\n{answers},\n" + ",\n".join(steps) + f"\nSELECT * FROM acc{last}"


@query("first_provider_with_news", _news_sql())
def first_provider_with_news(spark, folder):
    asked = posts(spark, folder).selectExpr(
        "k div 600 AS cycle", "CAST(k % 8 + 1 AS INT) AS intent_pos", "source_rank AS provider_rank",
        "source AS provider", "k AS position", "concat('u', k * 7 % 40) AS url",
    )
    quotas = asked.selectExpr("cycle", "intent_pos", "CAST(13 - intent_pos AS INT) AS quota").distinct()
    return discovery.first_provider_with_news(asked, quotas).drop("provider")


_RUN_TIER = (
    f"CASE WHEN published_at IS NULL THEN 1 WHEN published_at >= {CUTOFF_SQL} THEN 2 ELSE 0 END"
)


@query(
    "discovery_queue",
    "SELECT * FROM (SELECT cycle, n.intent_pos, n.provider_rank, position, n.url, tier, family, language, row_number() OVER "
    "(PARTITION BY cycle ORDER BY tier DESC, published_at DESC NULLS LAST, n.intent_pos, position, n.url) AS rank "
    f"FROM (SELECT n.*, p.published_at, {_RUN_TIER} AS tier FROM ("
    + "WITH "
    + _news_sql(6, "CASE WHEN intent_pos <= 2 THEN 4 ELSE 3 END").split("WITH ", 1)[1]
    + ") n JOIN (" + with_views(["posts"], "SELECT k, published_at FROM posts") + ") p ON n.position = p.k) n "
    + f"JOIN {_INTENT_TABLE} ON i.intent_pos = (cycle * 6 + n.intent_pos - 1) % 24 + 1) WHERE rank <= 5",
)
def discovery_queue(spark, folder):
    """Rotation, quotas, provider fallback, priority and top k in one plan."""
    asked = posts(spark, folder).selectExpr(
        "k div 600 AS cycle", "CAST(k % 8 + 1 AS INT) AS intent_pos", "source_rank AS provider_rank",
        "source AS provider", "k AS position", "concat('u', k * 7 % 40) AS url", "published_at",
    )
    found = jobs.discovery_run(asked, 5, total=20, now=NOW, max_age_hours=MAX_AGE_HOURS)
    return found.select("cycle", "intent_pos", "provider_rank", "position", "url", "tier", "family", "language", "rank")


# ---------------------------------------------------------------- priority
_TIER = f"CASE WHEN published_at IS NULL THEN 1 WHEN published_at >= {CUTOFF_SQL} THEN 2 ELSE 0 END"
_URLS = (
    f"SELECT *, {_TIER} AS tier FROM cands WHERE url <> '' QUALIFY row_number() OVER "
    f"(PARTITION BY url ORDER BY {_TIER} DESC, published_at DESC NULLS LAST, position) = 1"
)


@query("prioritize_candidates", with_views(["cands"], f"SELECT position, url, {_TIER} AS tier FROM cands"))
def prioritize_candidates(spark, folder):
    ranked = ordering.prioritize(candidates(spark, folder), now=NOW, max_age_hours=MAX_AGE_HOURS)
    return ranked.select("position", "url", "tier")


@query(
    "top_urls",
    with_views(
        ["cands"],
        f"SELECT url, tier, position FROM ({_URLS}) ORDER BY tier DESC, published_at DESC NULLS LAST, position LIMIT 50",
    ),
)
def top_urls(spark, folder):
    best = jobs.discovery_queue(candidates(spark, folder), 50, now=NOW, max_age_hours=MAX_AGE_HOURS)
    return best.select("url", "tier", "position")


@query(
    "distinct_urls",
    with_views(
        ["cands"],
        "SELECT url, provider, family, position FROM cands WHERE url <> '' "
        "QUALIFY row_number() OVER (PARTITION BY url ORDER BY position) = 1",
    ),
)
def unique_urls(spark, folder):
    return jobs.unique_candidates(candidates(spark, folder)).select("url", "provider", "family", "position")


@query(
    "limit_wanted",
    with_views(["cands"], "SELECT position, family FROM cands ORDER BY family, position LIMIT 120"),
)
def limit_wanted(spark, folder):
    return ordering.limit_wanted(candidates(spark, folder), 120, ["family", "position"]).select("position", "family")


@query(
    "show_with_omitted",
    with_views(
        ["cands"],
        "SELECT * FROM (SELECT url, 0 AS omitted FROM cands WHERE url <> '' GROUP BY url ORDER BY min(position) LIMIT 5) "
        "UNION ALL SELECT NULL, greatest(count(DISTINCT url) - 5, 0) FROM cands WHERE url <> ''",
    ),
)
def show_with_omitted(spark, folder):
    found = distinct_urls(candidates(spark, folder), [F.col("position")])
    return ordering.show_with_omitted(found, 5, ["position"])
