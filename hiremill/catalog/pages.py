"""Queries over pages, payloads, feeds and URLs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from hiremill.catalog.base import (
    CUTOFF_SQL,
    MAX_AGE_HOURS,
    NOW,
    conversations,
    epoch,
    posts,
    query,
    sql_any,
    web_pages,
    with_views,
)
from hiremill.functions import html, urls
from hiremill.plans import jobs
from hiremill.session import work_folder
from hiremill.sources.feeds import scan_rss_items
from hiremill.sources.messages import scan_messages
from hiremill.sources.pages import manual_access_pages, page_links, page_main_text, scan_result_pages
from hiremill.sources.payloads import scan_search_results


def sql_text(value: str) -> str:
    """Visible text of HTML, for the references the pages use."""
    bare = (
        rf"regexp_replace(regexp_replace(regexp_replace({value}, '(?s)<!--.*?-->', ' ', 'g'), "
        r"'(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)\s*>', ' ', 'g'), '(?s)<[!/?A-Za-z][^>]*>', ' ', 'g')"
    )
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
        bare = rf"regexp_replace({bare}, '&{name}\b;?', '{char}', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


_ARTICLE = r"regexp_extract(html, '(?s)<article>.*</article>')"


@query("html_to_text", f"SELECT page_id, {sql_text('html')} AS text FROM pages")
def html_to_text(spark, folder):
    return web_pages(spark, folder).select("page_id", html.html_to_text(F.col("html")).alias("text"))


_KNOWN = (("spam-farm", "Spam"), ("blog.", "Blog"))
_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '')"


@query(
    "detect_source",
    f"""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'Telegram' WHEN contains({_HOST}, 'spam-farm') THEN 'Spam'
  WHEN contains({_HOST}, 'blog.') THEN 'Blog' ELSE {_HOST} END AS source FROM pages""",
)
def detect_source_of_page(spark, folder):
    address = F.when(F.col("page_id") % 9 != 0, F.col("url"))
    return web_pages(spark, folder).select("page_id", urls.detect_source(address, _KNOWN).alias("source"))


_PREFIXES = ("/en/", "/fr/")
_PATH = "rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/')"
_SITE_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"
_CANONICAL = f"""CASE WHEN ({_SITE_HOST} = 'example.com' OR ends_with({_SITE_HOST}, '.example.com'))
  AND regexp_matches({_PATH}, '^/(en|fr)/.') THEN concat('https://www.example.com', {_PATH}) ELSE '' END"""


@query("canonicalize_url", f"SELECT page_id, {_CANONICAL} AS canonical FROM pages")
def canonicalize_url(spark, folder):
    canonical = urls.canonicalize_url(F.concat(F.lit("  "), "url"), "example.com", _PREFIXES)
    return web_pages(spark, folder).select("page_id", canonical.alias("canonical"))


_MARKERS = ("example.com/en/", "spam-farm")


@query("is_post_url_loose", f"SELECT page_id, {sql_any('url', _MARKERS)} AS is_post FROM pages")
def is_post_url_loose(spark, folder):
    return web_pages(spark, folder).select(
        "page_id", urls.is_post_url_loose(F.col("url"), _MARKERS).alias("is_post")
    )


@query(
    "unwrap_redirect_url",
    r"""SELECT page_id, CASE page_id % 3 WHEN 1 THEN regexp_replace(url, '^http:', 'https:') ELSE url END AS target
FROM pages""",
)
def unwrap_redirect_url(spark, folder):
    wrapped = F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&rut=ab%20c"))
    bare = F.regexp_replace("url", "^https?:", "")
    href = (
        F.when(F.col("page_id") % 3 == 0, wrapped)
        .when(F.col("page_id") % 3 == 1, bare)
        .otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    )
    return web_pages(spark, folder).select("page_id", urls.unwrap_redirect_url(href).alias("target"))


@query("page_main_text", f"SELECT page_id, substr({sql_text(_ARTICLE)}, 1, 4000) AS main_text FROM pages")
def main_text(spark, folder):
    text = page_main_text(F.col("html"), ("p.missing-class", "article"))
    return web_pages(spark, folder).select("page_id", text.alias("main_text"))


@query(
    "page_links",
    r"""SELECT page_id, min(i) - 1 AS position, url FROM (SELECT page_id, generate_subscripts(l, 1) AS i,
  concat('https://www.example.com', rtrim(unnest(l), '/')) AS url
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))
WHERE regexp_matches(url, '^https://www.example.com/t.') GROUP BY page_id, url""",
)
def links_of_pages(spark, folder):
    """Relative links are made absolute first, as the pages hold no others."""
    absolute = F.replace("html", F.lit('<a href="/'), F.lit('<a href="http://m.example.com/'))
    rows = web_pages(spark, folder).select("page_id", absolute.alias("html"))
    return page_links(rows, site="example.com", prefixes=("/t",))


@query(
    "scan_result_pages",
    r"""SELECT page_id, min(i) AS first_place, title, link FROM (SELECT page_id, generate_subscripts(l, 1) AS i,
  regexp_extract(unnest(l), '>([^<]*)<', 1) AS title, regexp_extract(unnest(l), 'href="([^"]*)"', 1) AS link
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages))
GROUP BY page_id, title, link""",
)
def result_rows(spark, folder):
    rows = scan_result_pages(web_pages(spark, folder))
    return rows.select("page_id", F.col("position").alias("first_place"), "title", "link")


_RESULTS = (
    # a page of marked anchors: the link behind a redirect, the snippet and the date inside the box of the anchor
    """<div class="x result"><h2><a rel="n" class="result__a" href="//duckduckgo.com/l/?uddg={encoded}&amp;rut=1">"""
    """First {id} &amp; Co - LinkedIn</a></h2><a class="result__snippet">Part <b>{id}</b>  of it</a><time datetime=" d{id} ">x</time>"""
    """</div><div class="result"><a class="result-link" href=" {url} ">again</a></div><a href="https://other.example/">other</a>""",
    # a page of list items: the first anchor of each, a snippet by rank of its selector, an item without anchor
    """<ol><li class="b_algo"><p>early</p><h2><a href="{url}">Second {id} | LinkedIn</a></h2><div class="b_caption"><p>Caption {id}</p>"""
    """</div><span class="news_dt"> Jul {id}, 2026 </span></li><li class="b_algo"><p>none</p></li></ol><a href="https://other.example/">other</a>""",
    # neither: every anchor, the snippet that follows, and no date outside a box; comments hold no anchors
    """<!-- <a class="result__a" href="https://hidden.example/">no</a> --><p><a href="{url}">Third {id}</a></p>"""
    """<p class="result-snippet">After {id}</p><time>d{id}</time><a name="top">no link</a>""",
)


def _result_pages(spark, folder):
    """Search-result pages of each of the three kinds, and challenge pages among them."""
    def page(template):
        parts = []
        for piece in re.split(r"({[a-z]+})", template):
            value = {"{id}": F.col("page_id").cast("string"), "{url}": F.col("url"), "{encoded}": F.url_encode("url")}
            parts.append(value.get(piece, F.lit(piece)))
        return F.concat(*parts)

    kind = F.col("page_id") % 3
    html = F.when(kind == 0, page(_RESULTS[0])).when(kind == 1, page(_RESULTS[1])).otherwise(page(_RESULTS[2]))
    guard = F.when(F.col("page_id") % 10 == 9, F.lit("<form id='challenge-form'>")).otherwise("")
    return web_pages(spark, folder).select("page_id", F.concat(F.lit("<html><body>"), html, guard).alias("html"))


@query(
    "scan_result_tiers",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('First ', page_id, ' & Co') WHEN 1 THEN concat('Second ', page_id)
    ELSE concat('Third ', page_id) END AS title, url AS target,
  CASE page_id % 3 WHEN 0 THEN concat('Part ', page_id, ' of it') WHEN 1 THEN concat('Caption ', page_id)
    ELSE concat('After ', page_id) END AS snippet,
  CASE page_id % 3 WHEN 0 THEN concat('d', page_id) WHEN 1 THEN concat('Jul ', page_id, ', 2026') ELSE '' END AS date_text
FROM pages WHERE page_id % 10 <> 9""",
)
def result_tiers(spark, folder):
    """Titles, links, snippets and dates of every kind of result page."""
    rows = scan_result_pages(_result_pages(spark, folder))
    return rows.select("page_id", "title", urls.unwrap_redirect_url(F.col("link")).alias("target"), "snippet", "date_text")


_MAIN_TEXTS = (
    '<article><p class="attributed-text-segment-list__content">{}</p></article>',
    '<article><div class="x-attributed-text-segment-list__content-y">{}</div></article>',
    '<p class="z attributed-text-segment-list__content">{}</p>',
    '<div class="attributed-text-segment-list__content-2">{}</div>',
    '<div class="feed-shared-update-v2__description-wrapper">{}</div>',
    '<span class="a feed-shared-inline-show-more-text">{}</span>',
    '<div data-test-id="main-feed-activity-card__commentary">{}</div>',
)


@query(
    "page_main_text_ranks",
    f"SELECT page_id, CASE WHEN page_id % {len(_MAIN_TEXTS) + 1} = {len(_MAIN_TEXTS)} THEN '' "
    "ELSE concat('Text & ', page_id, ' here') END AS main_text FROM pages",
)
def main_text_ranks(spark, folder):
    """Pages with the elements of all selectors in reverse: those of better rank are empty, those of lesser rank hold more."""
    rank = F.col("page_id") % (len(_MAIN_TEXTS) + 1)
    parts = []
    for number, markup in reversed(list(enumerate(_MAIN_TEXTS))):
        before, after = markup.split("{}")
        own = F.concat(F.lit("Text &amp; <i>"), F.col("page_id").cast("string"), F.lit("</i>\n here"))
        inside = F.when(rank == number, own).when(rank < number, F.lit("a text of lesser rank")).otherwise(F.lit(" <!-- none --> "))
        parts.append(F.concat(F.lit(before), inside, F.lit(after)))
    rows = web_pages(spark, folder).select("page_id", F.concat(*parts).alias("html"))
    return rows.select("page_id", page_main_text(F.col("html")).alias("main_text"))


@query(
    "requires_manual_access",
    f"""SELECT page_id, contains(lower({sql_text('html')}), 'that at') OR page_id % 4 = 0 AS manual FROM pages""",
)
def requires_manual_access(spark, folder):
    """Every fourth page gets a login form and loses its article."""
    form = F.concat(F.regexp_replace("html", "(?s)<article>.*</article>", ""), F.lit("<input id=p type='password'>"))
    rows = web_pages(spark, folder).withColumn(
        "html", F.when(F.col("page_id") % 4 == 0, form).otherwise(F.concat("html", F.lit('<input type="password">')))
    )
    manual = manual_access_pages(rows, selectors=("article",), markers=("that at",))
    return rows.select("page_id", manual.alias("manual"))


@query(
    "safety_stop",
    f"""SELECT page_id, CASE WHEN contains(lower({sql_text('html')}), 'that at') THEN 'Site protection detected.'
  WHEN page_id % 4 = 0 THEN 'Login is required.' END AS reason FROM pages""",
)
def safety_stop(spark, folder):
    form = F.when(F.col("page_id") % 4 == 0, '<INPUT type="password" name=p>').otherwise("<input type=text>")
    rows = web_pages(spark, folder).select("page_id", F.concat("html", form).alias("html"))
    reason = html.safety_stop(html.html_to_text(F.col("html")), F.col("html"), ("that at",))
    return rows.select("page_id", reason.alias("reason"))


# ---------------------------------------------------------------- payloads and feeds
def _payloads(spark, folder):
    """One payload per post: two non-objects, the post, a bare update link; some payloads are cut off."""
    hit = F.to_json(
        F.struct(
            F.concat("title", F.lit(" on LinkedIn")).alias("title"),
            F.concat(F.coalesce("url", F.lit("https://evil.com/posts/x")), F.lit("?utm=1")).alias("link"),
            F.col("description").alias("snippet"),
            F.date_format("published_at", "MMM d, yyyy").alias("date"),
        )
    )
    update = F.concat(
        F.lit('{"link": "https://de.linkedin.com/feed/update/u'), F.col("k").cast("string"),
        F.lit('/", "title": "nan", "snippet": 7}'),
    )
    payload = F.concat(
        F.when(F.col("k") % 2 == 0, '{"organic_results": ["text", 5, ').otherwise('{"organic": ["text", 5, '),
        hit, F.lit(", "), update, F.when(F.col("k") % 13 == 0, "").otherwise("]}"),
    )
    return posts(spark, folder).select(
        "k", F.col("source").alias("provider"), F.lit("q").alias("query"), payload.alias("payload")
    )


_HITS_SQL = with_views(
    ["posts"],
    """SELECT k, provider, url, search_title, snippet, date_text, position FROM (
  SELECT k, source AS provider, coalesce(url, '') AS url, title AS search_title, description AS snippet,
    coalesce(strftime(published_at, '%b %-d, %Y'), '') AS date_text, 3 AS position FROM posts
  UNION ALL SELECT k, source, concat('https://www.linkedin.com/feed/update/u', CAST(k AS VARCHAR)), '', '7', '', 4
    FROM posts) WHERE url <> '' AND k % 13 <> 0""",
)


@query("scan_search_results", _HITS_SQL)
def search_results(spark, folder):
    return scan_search_results(_payloads(spark, folder)).select(
        "k", "provider", "url", "search_title", "snippet", "date_text", "position"
    )


@query(
    "normalize_hits",
    with_views(
        ["prints"],
        f"""SELECT k, url, substr(sha256(lower(url)), 1, 32) AS fingerprint, source, {epoch('published_at')} AS seconds
FROM (SELECT * FROM prints WHERE url IS NOT NULL AND k % 13 <> 0
  QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY k) = 1) WHERE published_at >= {CUTOFF_SQL}""",
    ),
)
def normalized_hits(spark, folder):
    found = jobs.normalize_hits(_payloads(spark, folder), order=["k"], now=NOW, max_age_hours=MAX_AGE_HOURS)
    return found.select("k", "url", "fingerprint", "source", F.unix_seconds("published_at").alias("seconds"))


_ITEM = (
    "concat('<item><title>', title, ' - LinkedIn</title><link>', coalesce(url, ''), '</link><description>&lt;p&gt;', "
    "description, ' &amp;amp; more&lt;/p&gt;</description><pubDate>', {day}, ' 00:00:00 GMT</pubDate></item>')"
)


def _feeds(spark, folder):
    """One feed per post with two items; undated posts give a malformed feed, some a blank one."""
    item = _ITEM.format(day="date_format(published_at, 'EEE, dd MMM yyyy')")
    feed = (
        f"CASE WHEN published_at IS NULL THEN concat('<rss><channel><item><title>', title, '</item>') "
        f"WHEN k % 10 = 0 THEN '  ' ELSE concat('<rss version=\"2.0\"><channel><title>t</title>', {item}, "
        "'<item><link>x</link></item></channel></rss>') END AS rss"
    )
    return posts(spark, folder).selectExpr("k", feed)


@query(
    "scan_rss_items",
    with_views(
        ["posts"],
        """SELECT k, 1 AS position, title, coalesce(url, '') AS link, concat(description, ' & more') AS snippet,
  concat(strftime(published_at, '%a, %d %b %Y'), ' 00:00:00 GMT') AS date_text
FROM posts WHERE published_at IS NOT NULL AND k % 10 <> 0
UNION ALL SELECT k, 2, '', 'x', '', '' FROM posts WHERE published_at IS NOT NULL AND k % 10 <> 0""",
    ),
)
def rss_items(spark, folder):
    return scan_rss_items(_feeds(spark, folder))


@query(
    "feed_posts",
    with_views(
        ["posts"],
        f"""SELECT url, k, title, concat(description, ' & more') AS description, {epoch('published_at')} AS seconds
FROM posts WHERE published_at IS NOT NULL AND k % 10 <> 0 AND url IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY url ORDER BY k) = 1""",
    ),
)
def posts_of_feeds(spark, folder):
    found = jobs.feed_posts(_feeds(spark, folder), "Feed", ["k"])
    return found.select("url", "k", "title", "description", F.unix_seconds("published_at").alias("seconds"))


@query(
    "page_posts",
    rf"""SELECT page_id, concat('https://www.linkedin.com/posts/p-activity-', CAST(id AS VARCHAR)) AS url,
  (id >> 22) // 1000 AS seconds, substr({sql_text(_ARTICLE)}, 1, 4000) AS description
FROM (SELECT *, 7483822807449600000 + page_id AS id FROM pages)
WHERE page_id % 5 <> 0 AND NOT contains(lower({sql_text('html')}), 'that at')""",
)
def posts_of_pages(spark, folder):
    """Pages under post addresses; every fifth address has no date in it."""
    number = (F.lit(7483822807449600000) + F.col("page_id")).cast("string")
    address = F.concat(
        F.lit("https://de.linkedin.com/posts/p-"), F.when(F.col("page_id") % 5 == 0, "x-").otherwise("activity-"), number,
        F.lit("/?a=b"),
    )
    rows = web_pages(spark, folder).select("page_id", address.alias("url"), "html")
    found = jobs.page_posts(rows, "Pages", selectors=("article",), markers=("that at",))
    return found.select("page_id", "url", F.unix_seconds("published_at").alias("seconds"), "description")


@query(
    "scan_messages",
    "SELECT string_agg(text, chr(10) ORDER BY conv_id, turn) AS text FROM conversations "
    "GROUP BY conv_id // 20, turn // 50",
)
def messages(spark, folder):
    """Up to fifty turns of twenty conversations as one text file each, read back whole."""
    target = work_folder(spark, "messages")
    chats = conversations(spark, folder).withColumns({"archive": F.expr("conv_id div 20"), "part": F.expr("turn div 50")})
    ordered = chats.repartition("archive", "part").sortWithinPartitions("archive", "part", "conv_id", "turn")
    ordered.select("archive", "part", "text").write.partitionBy("archive", "part").text(target)
    return scan_messages(spark, target).select(F.regexp_replace("text", r"\n\z", "").alias("text"))
