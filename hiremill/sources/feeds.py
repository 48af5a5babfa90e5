"""RSS feeds as result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.functions.extract import clean_result_title
from hiremill.functions.html import decode_entities, html_to_text
from hiremill.functions.text import let, strip

#: Comments, sections of characters, instructions and declarations: markup in them is none.
_OPAQUE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z][^>\[]*(?:\[.*?\]\s*)?>"
_CDATA = "<![CDATA["
_TAG_OR_TEXT = r"""<[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>|[^<]++"""
_TAG_NAME = r"^<([^\s/>]+)"
_ATTRIBUTES = r"""(?:\s[^<>"']*+(?:"[^"]*"[^<>"']*+|'[^']*'[^<>"']*+)*+)?"""
#: An item whose children hold text alone: the first tag of a name is its first child of that name.
_FLAT = rf"^<item{_ATTRIBUTES}>\s*+(?:<([^\s<>/]++){_ATTRIBUTES}>[^<]*+</\1\s*+>[^<]*+)*+</item"
_XML_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_FIELDS = ("title", "link", "description", "pubDate")


def plain_markup(xml: Column) -> Column:
    """The same document of tags and text alone: comments and instructions go, sections are spelled with references."""

    def spelled(part: Column) -> Column:
        inside = F.substring(part, F.lit(len(_CDATA) + 1), F.length(part) - len(_CDATA) - 3)
        escaped = F.replace(F.replace(F.replace(inside, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(F.startswith(part, F.lit(_CDATA)), escaped).otherwise("")

    def joined(text: Column) -> Column:
        parts = F.zip_with(
            F.split(text, _OPAQUE, -1), F.regexp_extract_all(text, F.lit(_OPAQUE), F.lit(0)),
            lambda between, part: F.concat(between, F.coalesce(spelled(part), F.lit(""))),
        )
        return F.when(text.rlike("<[!?]"), F.array_join(parts, "")).otherwise(text)

    return let(xml, joined)


def item_texts(markup: Column) -> Column:
    """From each ``<item`` of a document of tags and text on, as far as it takes to hold the whole item.

    A piece ends before the next item begins; one that is not closed there holds other items, and goes on to the end.
    """

    def pieces(parts: Column) -> Column:
        def whole(part: Column, at: Column) -> Column:
            closed = F.contains(part, F.lit("</item")) | part.rlike(r"^<item[^>]*/>")
            rest = F.array_join(F.slice(parts, at + 1, F.size(parts)), "")
            return F.when(closed, part).otherwise(rest)

        return F.filter(F.transform(parts, whole), lambda part: part.rlike(r"^<item[\s/>]"))

    # what stands before the first item is none
    return let(F.split(markup, r"(?=<item[\s/>])", -1), pieces)


def child_texts(item: Column, names: Sequence[str] = _FIELDS) -> Column:
    """The text of the first direct child of each name: a struct, empty text for a child that is missing.

    Items with children of text alone are read by patterns, the others in a pass over their tags.
    """

    own = F.substring_index(item, "</item", 1)  # what follows belongs to others

    def text(name: str) -> Column:
        return strip(decode_entities(F.regexp_extract(own, rf"<{name}{_ATTRIBUTES}>([^<]*)<", 1), _XML_ENTITIES)).alias(name)

    return F.when(item.rlike(_FLAT), F.struct(*[text(n) for n in names])).otherwise(_nested_texts(item, names))


def _nested_texts(item: Column, names: Sequence[str]) -> Column:
    """One pass over the tags with the depth: a name counts right below the item, whatever stands deeper."""
    empty = F.lit(None).cast("string")
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("over"), empty.alias("open"), *[empty.alias(n) for n in names]
    )

    def step(state: Column, token: Column) -> Column:
        tag = F.startswith(token, F.lit("<"))
        closes = F.startswith(token, F.lit("</"))
        alone = tag & F.endswith(token, F.lit("/>"))
        opens = tag & ~closes & ~alone
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        name = F.when(tag & ~closes & (state["depth"] == 1), F.regexp_extract(token, _TAG_NAME, 1))
        open_ = (
            F.when(opens & (state["depth"] == 1), name).when(closes & (depth == 1), empty).otherwise(state["open"])
        )

        def field(own: str) -> Column:
            held = state[own]
            begins = (name == own) & held.isNull()
            # a second child of the name finds the text of the first, which its mark keeps apart
            adds = ~tag & (state["open"] == own)
            closed = closes & (depth == 1) & (state["open"] == own)
            mark = F.endswith(F.coalesce(held, F.lit("")), F.lit("\0"))
            return (
                F.when(begins, F.when(alone, F.lit("\0")).otherwise(""))
                .when(adds & ~mark, F.concat(held, token))
                .when(closed & ~mark, F.concat(held, F.lit("\0")))
                .otherwise(held)
            )

        moved = F.struct(
            depth.alias("depth"), (state["over"] | (tag & (depth == 0))).alias("over"), open_.alias("open"),
            *[field(n).alias(n) for n in names],
        )
        return F.when(state["over"], state).otherwise(moved)

    def text(found: Column, name: str) -> Column:
        raw = F.replace(F.coalesce(found[name], F.lit("")), F.lit("\0"), F.lit(""))
        return strip(decode_entities(raw, _XML_ENTITIES)).alias(name)

    tokens = F.regexp_extract_all(item, F.lit(_TAG_OR_TEXT), F.lit(0))
    return F.aggregate(tokens, start, step, lambda found: F.struct(*[text(found, n) for n in names]))


def scan_rss_items(feeds: DataFrame, rss: str = "rss") -> DataFrame:
    """One row per item of a well-formed feed, at any depth; blank or malformed feeds give no rows.

    Title, link, description and date are those right below the item. An item without any child gives no row.
    """
    parsed = F.from_xml(
        F.col(rss), "_corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    kept = [c for c in feeds.columns if c != rss]
    filled = feeds.filter(strip(F.coalesce(F.col(rss), F.lit(""))) != "")
    whole = filled.select(*kept, F.col(rss).alias("_rss"), parsed.alias("_feed")).filter(
        F.col("_feed._corrupt").isNull()
    )
    items = F.filter(item_texts(plain_markup(F.col("_rss"))), lambda item: ~item.rlike(r"^<item[^>]*(?:/>|>\s*</item)"))
    rows = whole.select(*kept, F.posexplode(items).alias("_at", "_item"))
    read = rows.select(*kept, "_at", child_texts(F.col("_item")).alias("_read"))
    return read.select(
        *kept,
        (F.col("_at") + 1).alias("position"),
        clean_result_title(F.col("_read.title")).alias("title"),
        F.col("_read.link").alias("link"),
        html_to_text(F.col("_read.description")).alias("snippet"),
        F.col("_read.pubDate").alias("date_text"),
    )
