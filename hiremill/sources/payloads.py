"""Landed search payloads as candidate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill import schemas, terms
from hiremill.functions.dates import resolve_published_at
from hiremill.functions.extract import clean_result_title, post_title, tag_markers
from hiremill.functions.text import clean_scalar, let
from hiremill.functions.urls import canonicalize_url, is_post_url_loose, unwrap_redirect_url
from hiremill.operators.once import select_where

RESULT_LISTS = ("organic_results", "organic")


def scan_search_results(
    payloads: DataFrame,
    payload: str = "payload",
    lists: Sequence[str] = RESULT_LISTS,
    *,
    site: str = terms.POST_SITE,
    prefixes: Sequence[str] = terms.POST_PATH_PREFIXES,
) -> DataFrame:
    """One candidate per hit whose link is a post page. Other columns of the payload row are kept.

    Elements that are not objects and payloads that are not JSON give no rows; each
    element is parsed on its own, so one bad hit does not hide its neighbours.
    """
    outer = ", ".join(f"{name} array<string>" for name in lists)
    kept = [c for c in payloads.columns if c != payload]
    parsed = payloads.select(*kept, F.from_json(payload, outer).alias("_lists"))
    hits = F.coalesce(*[F.col(f"_lists.{name}") for name in lists])
    rows = parsed.select(*kept, F.posexplode(hits).alias("_at", "_hit"))
    objects = rows.filter(F.startswith(F.ltrim("_hit"), F.lit("{")))
    fields = objects.withColumn("_hit", F.from_json("_hit", schemas.HITS))

    def text(name: str) -> Column:
        return clean_scalar(F.col(f"_hit.{name}"), terms.EMPTY_SCALARS)

    columns = {
        **{c: F.col(c) for c in kept},
        "url": canonicalize_url(text("link"), site, prefixes),
        "search_title": let(text("title"), lambda title: clean_result_title(title)),
        "snippet": text("snippet"),
        "date_text": text("date"),
        "position": F.col("_at") + 1,
    }
    return select_where(fields, columns, lambda row: row["url"] != "")


def candidates_to_posts(candidates: DataFrame) -> DataFrame:
    """Posts of the candidates that have a title and a snippet."""
    complete = candidates.filter((F.col("search_title") != "") & (F.col("snippet") != ""))
    titled = complete.withColumn("title", post_title(F.col("search_title"), F.col("snippet")))
    described = F.concat_ws(" ", "title", "snippet")
    return titled.select(
        *[c for c in candidates.columns if c not in ("search_title", "snippet", "date_text", "provider", "title")],
        "title",
        F.col("snippet").alias("description"),
        F.col("provider").alias("source"),
        F.lit(None).cast("string").alias("location"),
        tag_markers(F.concat_ws(" ", "title", "snippet", "search_title")).alias("stack"),
        resolve_published_at(F.col("date_text"), F.col("url")).alias("published_at"),
        described.alias("raw_text"),
    )


def scraped_to_posts(
    rows: DataFrame, source: str, markers: Sequence[str] = terms.POST_URL_MARKERS
) -> DataFrame:
    """Posts of scraped result rows (title, link, snippet, date_text): loose URL test, undated rows dropped."""
    columns = {
        **{c: F.col(c) for c in rows.columns if c not in ("title", "link")},
        "url": unwrap_redirect_url(F.col("link")),
        "search_title": clean_result_title(F.col("title")),
        "provider": F.lit(source),
    }
    named = select_where(rows, columns, lambda row: is_post_url_loose(row["url"], markers))
    posts = candidates_to_posts(named)
    return select_where(posts, {c: F.col(c) for c in posts.columns}, lambda row: row["published_at"].isNotNull())
