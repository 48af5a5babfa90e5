"""Text expressions shared by the extraction, filter and card jobs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as Unicode text tools see it: more than the blank that trim() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
# everything but a-z, A-Z, 0-9 and U+0400 to U+04FF; Java tests these ranges much faster than the negated class
_NOT_COMPARABLE = r"[\x00-/:-@\[-`{-\u03ff\u0500-\x{10ffff}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that needs a value in several places and computes it once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def collapse(text: Column) -> Column:
    """Every run of whitespace becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def non_blank(text: Column) -> Column:
    """The same for a value that is costly to compute."""
    return let(text, blank_to_null)


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def any_of(terms: Sequence[str]) -> str:
    """One alternation that finds any of the literal terms."""
    return "|".join(re.escape(term) for term in dict.fromkeys(terms))


def shortest_terms(terms: Sequence[str]) -> list[str]:
    """The lowercase terms without those that contain another one: a text holds any of both or none."""
    unique = list(dict.fromkeys(term.lower() for term in terms))
    return [t for t in unique if not any(other != t and other in t for other in unique)]


def has_any(lowered: Column, terms: Sequence[str]) -> Column:
    """An already lowercase text contains any of the terms."""
    words = F.array(*[F.lit(term) for term in shortest_terms(terms)])
    return F.exists(words, lambda word: F.contains(lowered, word))


def contains_any(text: Column, terms: Sequence[str], *, mode: str = "substring") -> Column:
    """Case-insensitive test for any term; a null text contains nothing.

    ``mode="token"`` accepts a term only between word boundaries, so that "Go"
    does not match inside "Django".
    """
    if not terms:
        return F.lit(False)
    if mode == "substring":
        found = let(F.lower(text), lambda lowered: has_any(lowered, terms))
    elif mode == "token":
        pattern = any_of([term.lower() for term in terms])
        found = F.lower(text).rlike(rf"(?U)(?<!\w)(?:{pattern})(?!\w)")
    else:
        raise ValueError(f"unknown match mode: {mode}")
    return F.coalesce(found, F.lit(False))


def clean_scalar(value: Column, empty: Sequence[str]) -> Column:
    """Null and textual null markers become the empty string."""
    text = strip(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin(*empty), "").otherwise(text)


def trim_text(text: Column, max_chars: int) -> Column:
    """Collapsed text; a longer one keeps ``max_chars - 1`` characters and gets '...'."""
    flat = collapse(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, max_chars - 1)), F.lit("..."))
    return F.when(F.length(flat) <= max_chars, flat).otherwise(cut)


def comparable_text(text: Column) -> Column:
    """Lowercase Latin and Cyrillic letters and digits, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), _NOT_COMPARABLE, " "))


def count_chars(text: Column, char_class: str) -> Column:
    """Characters of the class. Removing them is much faster in Java than removing all others."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def script_below(text: Column, script: str, letters: str, min_ratio: float) -> Column:
    """Has letters, and too few of them belong to the script."""
    return _script_test(text, script, letters, lambda ratio: ratio < min_ratio)


def script_reached(text: Column, script: str, letters: str, min_ratio: float) -> Column:
    return _script_test(text, script, letters, lambda ratio: ratio >= min_ratio)


def _script_test(text: Column, script: str, letters: str, test: Callable[[Column], Column]) -> Column:
    def ratio(total: Column) -> Column:
        return (total > 0) & test(count_chars(text, script) / total)

    return F.coalesce(let(count_chars(text, letters), ratio), F.lit(False))


def unique_in_order(items: Column) -> Column:
    return F.array_distinct(items)
