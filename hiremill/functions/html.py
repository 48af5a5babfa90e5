"""HTML expressions: visible text, links and page markers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.text import collapse, contains_any, let

_HIDDEN = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""(?s)<(?:/?[A-Za-z]|[!?])[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>"""
_ENTITY = r"^(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+));?"
_CLOSED_NAME = r"^([A-Za-z][A-Za-z0-9]*);"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
_PASSWORD_INPUT = r"""(?is)<input\b[^>]*\btype\s*=\s*(?:"password"|'password'|password[\s/>])"""

# named references of HTML 5, from the standard library; the common ones of HTML 4 are looked up first
NAMED_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {
    name[:-1]: value for name, value in html5.items() if name.endswith(";")
}
# names that also count without their semicolon, the longest first
_OPEN_NAMES = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))
_TABLE_TYPE = "map<string, map<string, string>>"


def _table(names: Mapping[str, str]) -> str:
    """The names by their first letters, as the text of one literal: a lookup then passes few of them."""
    found: dict[str, dict[str, str]] = {}
    for name, value in names.items():
        found.setdefault(name[0], {})[name] = value
    return json.dumps(found)


_NAMED_TABLE = _table(NAMED_ENTITIES)
_WINDOWS = "".join(bytes([code]).decode("cp1252", "replace") for code in range(0x80, 0xA0))


def decode_entities(text: Column, names: Mapping[str, str] = NAMED_ENTITIES) -> Column:
    """Numeric and named character references as characters; unknown names stay.

    A name ends at its semicolon; of one without, the longest known beginning counts. Numbers from
    128 to 159 mean the characters of the Windows code page.
    """
    table = F.from_json(F.lit(_NAMED_TABLE if names is NAMED_ENTITIES else _table(names)), _TABLE_TYPE)

    def named(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(table, F.left(name, F.lit(1))), name)

    begin = "^(" + "|".join(n for n in _OPEN_NAMES.split("|") if n in names) + ")"

    def decode(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, _ENTITY, 1)
        hexadecimal = F.regexp_extract(piece, _ENTITY, 2)
        number = F.coalesce(
            F.nullif(decimal, F.lit("")), F.conv(F.right(F.nullif(hexadecimal, F.lit("")), F.lit(12)), 16, 10)
        )
        code = F.when(number.isNotNull(), F.coalesce(number.try_cast("int"), F.lit(-1)))
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        windows = F.nullif(F.substring(F.lit(_WINDOWS), code - 0x7F, F.lit(1)), F.lit("\ufffd"))
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
        numeric = F.when(valid, F.when(code.between(0x80, 0x9F), F.coalesce(windows, plain)).otherwise(plain)).otherwise("�")
        closed = F.when(piece.rlike(_CLOSED_NAME), named(F.regexp_extract(piece, _CLOSED_NAME, 1)))
        opened = named(F.nullif(F.regexp_extract(piece, begin, 1), F.lit("")))
        found = F.coalesce(
            F.when(code.isNotNull(), F.concat(numeric, F.regexp_replace(piece, _ENTITY, ""))),
            F.concat(closed, F.regexp_replace(piece, _CLOSED_NAME, "")),
            F.concat(opened, F.regexp_replace(piece, begin, "")),
            F.concat(F.lit("&"), piece),
        )
        # most pieces of a text are references; a blank or a digit after the mark never is one
        return F.when(piece.rlike("^[#A-Za-z]"), found).otherwise(F.concat(F.lit("&"), piece))

    def join(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, 2, 1 << 30), decode)
        return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))

    return let(F.split(text, "&"), join)


_ATTRIBUTE_ENTITIES = {"amp": "&", "quot": '"', "lt": "<", "gt": ">", "apos": "'"}


def visible_markup(html: Column) -> Column:
    """The page without comments and invisible elements; each leaves one blank."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENT, " ")
    return F.regexp_replace(bare, _HIDDEN, " ")


def strip_tags(html: Column) -> Column:
    """Every tag, comment and invisible element as one blank."""
    return F.regexp_replace(visible_markup(html), _TAG, " ")


def html_to_text(html: Column, names: Mapping[str, str] = NAMED_ENTITIES) -> Column:
    return collapse(decode_entities(strip_tags(html), names))


def page_title(html: Column) -> Column:
    return html_to_text(F.regexp_extract(html, _TITLE, 1))


def anchor_hrefs(html: Column) -> Column:
    """href values of the anchors in page order, entities decoded."""
    tags = F.regexp_extract_all(visible_markup(html), F.lit(_HREF), F.lit(0))
    return F.transform(
        tags,
        lambda tag: decode_entities(
            F.concat(
                F.regexp_extract(tag, _HREF, 1), F.regexp_extract(tag, _HREF, 2), F.regexp_extract(tag, _HREF, 3)
            ),
            _ATTRIBUTE_ENTITIES,
        ),
    )


def is_challenge_page(html: Column, markers: Sequence[str] = terms.CHALLENGE_MARKERS) -> Column:
    return contains_any(html, markers)


def has_password_input(html: Column) -> Column:
    return F.coalesce(html.rlike(_PASSWORD_INPUT), F.lit(False))


def requires_manual_access(
    html: Column, main_text: Column, markers: Sequence[str] = terms.PROTECTION_MARKERS
) -> Column:
    """A protection phrase is visible, or a login form stands where the main text should be."""
    walled = has_password_input(html) & (F.coalesce(main_text, F.lit("")) == "")
    return contains_any(html_to_text(html), markers) | walled


def safety_stop(
    body: Column,
    html: Column,
    markers: Sequence[str] = terms.PAGE_GUARD_MARKERS,
    reasons: Sequence[str] = terms.PAGE_GUARD_REASONS,
) -> Column:
    """Why a form page is left to a person: a protection marker in its text, a login; null to go on."""
    protected, login = reasons
    return F.when(contains_any(body, markers), protected).when(has_password_input(html), login)


def verified_success(
    body: Column, form_visible: Column, markers: Sequence[str] = terms.SUCCESS_MARKERS
) -> Column:
    return ~form_visible & contains_any(body, markers)
