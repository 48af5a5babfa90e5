"""The jobs over whole tables. Each is one lazy plan over the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions import cards, dates, extract
from hiremill.functions.dates import timestamp_from_activity_id
from hiremill.functions.html import html_to_text, page_title
from hiremill.functions.text import blank_to_null, contains_any, strip
from hiremill.functions.urls import canonicalize_url, detect_source, extract_urls, public_origin_url
from hiremill.operators import aggregates, applications, discovery, filters, localization, ordering
from hiremill.operators.dedupe import distinct_urls, first_n, first_wins, new_posts, with_fingerprint
from hiremill.operators.once import select_where
from hiremill.sources.feeds import scan_rss_items
from hiremill.sources.ledger import evolve_ledger, rows_to_publish
from hiremill.sources.pages import page_main_text, scan_result_pages
from hiremill.sources.payloads import candidates_to_posts, scan_search_results, scraped_to_posts


def parse_posts(
    messages: DataFrame, text: str = "text", fallback_source: str = terms.MESSAGE_SOURCE
) -> DataFrame:
    """Structured posts of raw messages. A labelled value wins over a guessed one.

    The columns of the message row are kept. Every step is one projection, so each
    pattern runs once per message.
    """
    kept = [F.col(c) for c in messages.columns if c != text]
    step = messages.select(*kept, strip(F.coalesce(F.col(text), F.lit(""))).alias("raw_text"))
    step = step.withColumns(
        {
            "url": F.try_element_at(extract_urls(F.col("raw_text")), F.lit(1)),
            "_body": strip(F.regexp_replace("raw_text", terms.URL_PATTERN, "")),
        }
    )
    step = step.withColumn("_lines", extract.marked_lines(F.col("_body")))
    step = step.withColumn("_labeled", extract.labels_of(F.col("_lines")))
    fields = extract.labeled_field_columns(F.col("_body"), F.col("_labeled"))
    step = step.withColumns({f"_{name}": value for name, value in fields.items()})
    step = step.withColumns(
        {
            "title": extract.guess_title(F.when(F.col("_body") != "", F.col("_body")).otherwise(F.col("raw_text"))),
            "_text": F.coalesce("_description", extract.unlabeled_text(F.col("_lines"))),
        }
    )
    stack = F.when(F.col("_stack").isNotNull(), extract.parse_stack_value(F.col("_stack"))).otherwise(
        extract.extract_stack_with_evidence(F.col("_text"))
    )
    after_title = F.expr("substring(_text, length(title) + 1)")
    return step.select(
        *kept,
        "title",
        F.when(F.startswith(F.col("_text"), F.col("title")), F.btrim(after_title, F.lit(" \n:-")))
        .otherwise(F.col("_text"))
        .alias("description"),
        F.when(F.col("url").isNotNull(), detect_source(F.col("url"))).otherwise(fallback_source).alias("source"),
        "url",
        F.coalesce("_location", extract.guess_location(F.col("_body"))).alias("location"),
        F.col("_company").alias("company"),
        stack.alias("stack"),
        F.coalesce("_salary", extract.guess_salary(F.col("_body"))).alias("salary"),
        "raw_text",
    )


def intake_posts(messages: DataFrame, text: str = "text") -> DataFrame:
    """Posts of the messages that look like postings, with the public origin as URL where they have none.

    Optional columns origin_username and origin_message_id name the forwarded message.
    """
    posts = parse_posts(filters.filter_intake(messages, text), text)
    if {"origin_username", "origin_message_id"} <= set(posts.columns):
        origin = public_origin_url(F.col("origin_username"), F.col("origin_message_id"))
        missing = blank_to_null(F.col("url")).isNull() & origin.isNotNull()
        posts = posts.withColumn("source", F.when(missing, terms.MESSAGE_SOURCE).otherwise(F.col("source")))
        posts = posts.withColumn("url", F.when(missing, origin).otherwise(F.col("url")))
    return with_fingerprint(posts)


def with_card(posts: DataFrame) -> DataFrame:
    """Posts with their rendered card; columns a table lacks count as missing."""

    def field(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in posts.columns else F.lit(None).cast(kind)

    card = cards.render_card(
        F.col("title"), field("company"), field("location"), field("salary"), field("stack", "array<string>"),
        F.col("description"), field("url"), F.col("source"),
    )
    return posts.withColumn("card", card)


def allowed_posts(
    posts: DataFrame,
    *,
    now: datetime,
    max_age_hours: int,
    require_published_at: bool = False,
    allow: Sequence[str] = terms.ALLOWED_ROLE_TERMS,
    deny: Sequence[str] = terms.DENIED_ROLE_TERMS,
) -> DataFrame:
    """Fresh posts the role policy allows, with fingerprints."""
    fresh = filters.filter_fresh(
        posts, now=now, max_age_hours=max_age_hours, require_published_at=require_published_at
    )
    return with_fingerprint(filters.filter_role_policy(fresh, allow, deny))


def eligible_posts(
    posts: DataFrame, ledger: DataFrame, *, order: Sequence[str] = ("source_rank", "position"), **options
) -> DataFrame:
    """Allowed, fresh posts the ledger does not hold, each once."""
    return new_posts(allowed_posts(posts, **options), ledger, [F.col(c) for c in order])


def publishable_posts(
    posts: DataFrame,
    ledger: DataFrame,
    *,
    max_posts: int,
    order: Sequence[str] = ("source_rank", "position"),
    **options,
) -> DataFrame:
    """What one poll publishes: eligible posts up to the cap, with their cards."""
    eligible = eligible_posts(posts, ledger, order=order, **options)
    return with_card(ordering.publish_cap(eligible, max_posts, order))


def publishable_one_shot(
    posts: DataFrame, ledger: DataFrame, *, max_posts: int, now: datetime, max_age_hours: int
) -> DataFrame:
    """The one-shot variant: each source is cut to the rest of the cap before dedupe."""
    allowed = allowed_posts(posts, now=now, max_age_hours=max_age_hours)
    return with_card(discovery.cap_then_dedupe(allowed, ledger, max_posts))


def normalize_hits(
    payloads: DataFrame, payload: str = "payload", *, order: Sequence[str], now: datetime, max_age_hours: int, **site
) -> DataFrame:
    """Fresh, dated posts of landed search payloads, with fingerprints.

    A provider names a URL once: its first hit counts, in the order of the payload columns ``order``
    and then of the hits. payloads: provider, query and the payload text.
    """
    found = scan_search_results(payloads, payload, **site)
    once = first_wins(found, ["provider", "url"], [*[F.col(c) for c in order], F.col("position")])
    made = candidates_to_posts(once).withColumn("company", F.lit(None).cast("string"))
    fresh = filters.filter_fresh(made, now=now, max_age_hours=max_age_hours, require_published_at=True)
    return with_fingerprint(fresh)


def feed_posts(feeds: DataFrame, source: str, order: Sequence[str], rss: str = "rss") -> DataFrame:
    """Posts of RSS feeds, each URL once; ``order`` names the feed columns that order the feeds."""
    posts = scraped_to_posts(scan_rss_items(feeds, rss), source)
    return first_wins(posts, ["url"], [*[F.col(c) for c in order], F.col("position")])


def result_page_posts(pages: DataFrame, source: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Posts of search-result pages, each URL once."""
    posts = scraped_to_posts(scan_result_pages(pages, key, html), source)
    return first_wins(posts, ["url"], [F.col(key), F.col("position")])


def page_posts(
    pages: DataFrame,
    source: str,
    *,
    site: str = terms.POST_SITE,
    prefixes: Sequence[str] = terms.POST_PATH_PREFIXES,
    selectors: Sequence[str] = terms.MAIN_TEXT_SELECTORS,
    markers: Sequence[str] = terms.PROTECTION_MARKERS,
) -> DataFrame:
    """Posts of post pages (url, html).

    The address gives the date, so pages without one are left out before any is parsed;
    so are pages that need a person and pages without main text afterwards.
    """
    kept = [c for c in pages.columns if c not in ("url", "html")]
    address = {
        **{c: F.col(c) for c in kept},
        "url": canonicalize_url(F.col("url"), site, prefixes),
        "published_at": timestamp_from_activity_id(F.col("url")),
        "html": F.col("html"),
    }
    dated = select_where(pages, address, lambda row: (row["url"] != "") & row["published_at"].isNotNull())
    text = page_main_text(F.col("html"), selectors)
    read = {
        **{c: F.col(c) for c in (*kept, "url", "published_at")},
        "description": text,
        "page_title": page_title(F.col("html")),
        "guarded": contains_any(html_to_text(F.col("html")), markers),
    }
    # a login form matters only where the main text is missing, and those pages go anyway
    open_pages = select_where(dated, read, lambda row: (row["description"] != "") & ~row["guarded"])
    titled = open_pages.withColumn("title", extract.post_title(F.col("page_title"), F.col("description")))
    both = F.concat_ws(" ", "title", "description")
    return titled.filter(F.col("title") != "").select(
        *kept, "url", "title", "description", F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("location"), extract.tag_markers(both).alias("stack"), "published_at",
        both.alias("raw_text"),
    )


def resolve_dates(rows: DataFrame, *, now: datetime, date_text: str = "date_text", url: str = "url") -> DataFrame:
    """Publication instant, age in whole hours and age class of every row."""
    dated = rows.withColumn("published_at", dates.resolve_published_at(F.col(date_text), F.col(url)))
    age = F.unix_seconds(dates.moment_literal(now, dated.schema["published_at"].dataType)) - F.unix_seconds(
        "published_at"
    )
    hours = F.ceil(age / 3600)
    return dated.withColumn("age_hours", hours).withColumn(
        "age_class", F.when(F.col("published_at").isNotNull(), dates.recency_bucket(F.col("age_hours")))
    )


def discovery_plan(
    cycles: DataFrame, *, total: int, max_intents: int = terms.INTENTS_PER_CYCLE
) -> DataFrame:
    """The intents every cycle searches and the quota of each."""
    rotated = discovery.rotate_intents(cycles, max_intents)
    budget = max(total, min(max_intents, len(terms.default_intents())))
    slots = rotated.drop("intent_pos").withColumnRenamed("slot", "intent_pos")
    return discovery.fair_quota(slots, budget, ["cycle"])


def discovery_queue(
    candidates: DataFrame, k: int, *, now: datetime, max_age_hours: int, order: Sequence[str] = ("position",)
) -> DataFrame:
    """The next ``k`` URLs to read."""
    return ordering.top_urls(candidates, k, now=now, max_age_hours=max_age_hours, order=order)


def discovery_run(
    answers: DataFrame,
    k: int,
    *,
    total: int,
    now: datetime,
    max_age_hours: int,
    max_intents: int = terms.INTENTS_PER_CYCLE,
) -> DataFrame:
    """What every cycle reads next: its intents with their quotas, the first provider with news for
    each, and the first ``k`` URLs in priority order, with their rank.

    answers: cycle, intent_pos (the place of the intent in its cycle), provider_rank, provider,
    position, url, published_at.
    """
    plan = discovery_plan(answers.select("cycle").distinct(), total=total, max_intents=max_intents)
    news = discovery.first_provider_with_news(answers, plan.select("cycle", "intent_pos", "quota"))
    ranked = ordering.with_tier(news, now=now, max_age_hours=max_age_hours)
    best = [*ordering.priority_order(("intent_pos", "position", "url"))]
    kept = first_n(ranked, ["cycle"], best, max(k, 0), rank="rank")
    family = plan.select("cycle", "intent_pos", "family", "language")
    return kept.join(family, ["cycle", "intent_pos"])


def discovery_report(candidates: DataFrame, query_log: DataFrame, **options) -> DataFrame:
    return aggregates.discovery_report(candidates, query_log, **options)


def localization_gate(posts: DataFrame, texts: DataFrame, key: str, **options) -> DataFrame:
    return localization.localize_posts(posts, texts, key, **options)


def ledger_maintenance(posts: DataFrame, ledger: DataFrame, order: Sequence[str]) -> DataFrame:
    """The ledger after these posts: its rows and the newly inserted ones."""
    rows = rows_to_publish(with_fingerprint(posts), ledger, [F.col(c) for c in order])
    return evolve_ledger(ledger, rows)


def application_ledger(updates: DataFrame, ledger: DataFrame, **options) -> DataFrame:
    """Status of every application after the whole feed."""
    return applications.final_statuses(applications.decide_updates(updates, ledger, **options))


def unique_candidates(candidates: DataFrame, order: Sequence[str] = ("position",)) -> DataFrame:
    return distinct_urls(candidates, [F.col(c) for c in order])

