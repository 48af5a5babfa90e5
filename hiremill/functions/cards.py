"""Rendering of a post as an HTML card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.text import blank_to_null, let, trim_text

# --- Fixed values: card layout --------------------------------------------
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
_TITLE = "💼 <b>{}</b>"
_FIELD = "{} <b>{}</b>: "
_COMPANY, _LOCATION, _SALARY, _STACK = ("🏢", "Компания"), ("📍", "Локация"), ("💰", "Зарплата"), ("🧠", "Стек")
_DESCRIPTION_HEADING = "<b>Описание</b>"
_LINK = ('🔗 <a href="', '"><b>Смотреть вакансию</b></a>')
_SOURCE = "▫️ Источник: "
_NO_STACK = "—"


def escape_html(text: Column) -> Column:
    for char, reference in _ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def _field(label: tuple[str, str], value: Column) -> Column:
    """A blank line and the field; null when the value is missing or empty."""
    return F.concat(F.lit("\n" + _FIELD.format(*label)), escape_html(blank_to_null(value)))


def render_card(
    title: Column,
    company: Column,
    location: Column,
    salary: Column,
    stack: Column,
    description: Column,
    url: Column,
    source: Column,
    *,
    max_tags: int = terms.MAX_CARD_TAGS,
    max_description: int = terms.MAX_CARD_DESCRIPTION_CHARS,
) -> Column:
    head, tail = _TITLE.split("{}")
    shown = F.when(F.size(stack) > 0, F.array_join(F.slice(stack, 1, max_tags), ", "))
    link = F.concat(F.lit("\n" + _LINK[0]), escape_html(blank_to_null(url)), F.lit(_LINK[1]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit(head), escape_html(F.coalesce(blank_to_null(title), F.lit(terms.DEFAULT_TITLE))), F.lit(tail)),
        _field(_COMPANY, company),
        _field(_LOCATION, location),
        _field(_SALARY, salary),
        _field(_STACK, F.coalesce(shown, F.lit(_NO_STACK))),
        let(
            trim_text(description, max_description),
            lambda text: F.concat(F.lit(f"\n{_DESCRIPTION_HEADING}\n"), escape_html(blank_to_null(text))),
        ),
        link,
        F.concat(F.lit(_SOURCE), escape_html(source)),
    )
