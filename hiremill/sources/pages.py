"""Web pages: main text, links and search-result rows.

Rules that depend on nesting parse the page inside Arrow batches; everything that a
pattern can decide stays in Spark expressions, before and after.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.extract import clean_result_title
from hiremill.functions.html import (
    anchor_hrefs,
    has_password_input,
    is_challenge_page,
    requires_manual_access,
)
from hiremill.functions.text import any_of
from hiremill.functions.urls import canonicalize_url, unwrap_redirect_url
from hiremill.operators.dedupe import first_wins
from hiremill.operators.once import select_where
from hiremill.sources.dom import Element, Page, first_texts, mark_of

# --- Fixed values: selectors of search-result pages -----------------------
RESULT_ANCHORS = "a.result__a,a.result-link"
RESULT_CONTAINERS = "li.b_algo"
CONTAINER_ANCHOR = "h2 a[href],a[href]"
ANY_ANCHOR = "a[href]"
RESULT_CLASS = "result"
SNIPPET_CLASSES = frozenset(("result__snippet", "result-snippet"))
CONTAINER_SNIPPETS = (".b_caption p", ".b_snippet", ".result__snippet", ".result-snippet", "p")
DATE_ELEMENTS = "time,.news_dt,[class*=date],[class*=time]"


def page_main_text(
    html: Column,
    selectors: Sequence[str] = terms.MAIN_TEXT_SELECTORS,
    max_chars: int = terms.MAX_PAGE_TEXT_CHARS,
) -> Column:
    """Text of the first element, in selector order, that has any.

    Pages without any trace of the selectors are settled in Spark and are not parsed. A Python
    worker holds Spark's Arrow batch, one page of it as a string and the texts of a few pages.
    """
    rules = list(selectors)

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return first_texts(batches, rules, max_chars)

    present = F.lower(html).rlike(any_of([mark_of(rule).lower() for rule in rules]))
    return F.coalesce(main_text(F.when(present, html)), F.lit(""))


def page_links(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    *,
    site: str = terms.POST_SITE,
    prefixes: Sequence[str] = terms.POST_PATH_PREFIXES,
) -> DataFrame:
    """Canonical post links of every page, each once, in page order; a page that needs a person has none."""
    # the main text matters only beside a login form, so no other page is parsed for it
    main_text = page_main_text(F.when(has_password_input(F.col(html)), F.col(html)))
    open_pages = pages.filter(~F.coalesce(requires_manual_access(F.col(html), main_text), F.lit(False)))
    links = open_pages.select(key, F.posexplode(anchor_hrefs(F.col(html))).alias("position", "_href"))
    columns = {
        key: F.col(key),
        "position": F.col("position"),
        "url": canonicalize_url(F.col("_href"), site, prefixes),
    }
    posts = select_where(links, columns, lambda row: row["url"] != "")
    return first_wins(posts, [key, "url"], [F.col("position")])


def scan_result_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Result rows (title, link, snippet, date_text) of search pages, each link once per page.

    Anti-bot pages give no rows. The page-specific anchors come first; all anchors of the
    page are used only where those find nothing.
    """
    readable = pages.filter(~is_challenge_page(F.col(html))).select(key, html)
    key_type = readable.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, position int, title string, link string, snippet string, date_text string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page_key, place, *result)
                for page_key, source in zip(batch[key], batch[html], strict=True)
                for place, result in enumerate(_results(Page(source)), start=1)
            ]
            columns = [key, "position", "title", "link", "snippet", "date_text"]
            yield pd.DataFrame(rows, columns=columns).astype({key: batch[key].dtype, "position": "int32"})

    rows = readable.mapInPandas(parse, schema).withColumn("_target", unwrap_redirect_url(F.col("link")))
    once = first_wins(rows.filter(F.col("_target") != ""), [key, "_target"], [F.col("position")])
    return once.drop("_target").withColumn("title", clean_result_title(F.col("title")))


def _results(page: Page) -> list[tuple[str, str, str, str]]:
    boxes = page.nearest(RESULT_CLASS)
    snippets = [e.index for e in page.elements if e.classes & SNIPPET_CLASSES]

    def of_anchor(anchor: Element) -> tuple[str, str, str, str]:
        box = boxes[anchor.index]
        inside = snippets[bisect_right(snippets, box.index) : bisect_left(snippets, box.end)] if box else []
        at = bisect_right(snippets, anchor.index)
        after = snippets[at : at + 1]
        texts = (page.text(page.elements[i]) for i in (*inside, *after))
        date = _date_text(page, box) if box else ""
        return page.text(anchor), anchor.attrs.get("href", ""), next((t for t in texts if t), ""), date

    found = [of_anchor(anchor) for anchor in page.select(RESULT_ANCHORS)]
    for container in page.select(RESULT_CONTAINERS):
        anchor = page.first(CONTAINER_ANCHOR, container)
        if anchor is not None:
            snippet = _container_snippet(page, container)
            found.append((page.text(anchor), anchor.attrs.get("href", ""), snippet, _date_text(page, container)))
    if any(link.strip() for _, link, _, _ in found):
        return found
    return [of_anchor(anchor) for anchor in page.select(ANY_ANCHOR)]


def _container_snippet(page: Page, container: Element) -> str:
    firsts = (page.first(selector, container) for selector in CONTAINER_SNIPPETS)
    return next((text for text in (page.text(e) for e in firsts if e is not None) if text), "")


def _date_text(page: Page, container: Element) -> str:
    for element in page.select(DATE_ELEMENTS, container):
        value = (element.attrs.get("datetime") or page.text(element)).strip()
        if value:
            return value
    return ""


def manual_access_pages(
    pages: DataFrame,
    html: str = "html",
    selectors: Sequence[str] = terms.MAIN_TEXT_SELECTORS,
    markers: Sequence[str] = terms.PROTECTION_MARKERS,
) -> Column:
    """Page rows that cannot be read without a person."""
    return requires_manual_access(F.col(html), page_main_text(F.col(html), selectors), markers)
