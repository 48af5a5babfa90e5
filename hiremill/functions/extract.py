"""Extraction rules of the message parser, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.text import (
    collapse,
    contains_any,
    has_any,
    let,
    lines,
    non_blank,
    strip,
    unique_in_order,
)

_BULLETS = " -•\t"
_PART_EDGES = " •,;"


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def keyword_hits(
    lowered: Column,
    keywords: Sequence[str] = terms.TECH_KEYWORDS,
    generic: str = terms.GENERIC_KEYWORD,
    specific: Sequence[str] = terms.SPECIFIC_KEYWORDS,
) -> Column:
    """Keywords contained in an already lowercase text, in dictionary order.

    The generic keyword gives way where a specific one is found.
    """
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(w.lower()).alias("key")) for w in keywords])

    def hit(entry: Column) -> Column:
        found = F.contains(lowered, entry["key"])
        if not specific:
            return found
        return found & ~((entry["word"] == generic) & has_any(lowered, specific))

    return F.transform(F.filter(words, hit), lambda entry: entry["word"])


def extract_stack(text: Column, **dictionary) -> Column:
    return let(F.lower(text), lambda lowered: keyword_hits(lowered, **dictionary))


def extract_stack_with_evidence(
    text: Column,
    evidence: Sequence[str] = terms.STACK_EVIDENCE_TERMS,
    vague: Sequence[str] = terms.VAGUE_KEYWORDS,
    **dictionary,
) -> Column:
    """Keywords of the sentences that say the technology is used."""
    sentences = F.split(F.lower(text), r"[\n.!?]+")
    telling = F.filter(sentences, lambda s: has_any(s, evidence))
    hits = F.flatten(F.transform(telling, lambda s: keyword_hits(s, **dictionary)))
    return unique_in_order(F.filter(hits, lambda word: ~word.isin(*vague)))


def marked_lines(text: Column, pattern: str = terms.LABEL_LINE_PATTERN) -> Column:
    """Every line with its parts: nothing, label and value for a ``Label: value`` line, else one part or none."""

    def mark(line: Column) -> Column:
        parts = F.split(F.regexp_replace(line, pattern, "\x00$1\x00$2"), "\x00", 3)
        # the cheap test for a colon spares most lines the pattern
        return F.struct(line.alias("line"), F.when(line.rlike("[:：]"), parts).alias("parts"))

    return F.transform(lines(text), mark)


def _is_labeled(marked: Column) -> Column:
    parts = marked["parts"]
    return F.coalesce((F.size(parts) == 3) & (F.get(parts, 0) == ""), F.lit(False))


def labels_of(marked: Column) -> Column:
    """(label, value) of the labelled ones of marked lines, in order."""
    return F.transform(
        F.filter(marked, _is_labeled),
        lambda x: F.struct(collapse(F.lower(x["parts"][1])).alias("label"), strip(x["parts"][2]).alias("value")),
    )


def unlabeled_text(marked: Column, headings: Sequence[str] = terms.FIELD_LABELS["description"]) -> Column:
    """The other ones of marked lines, without empty headings."""

    def is_heading(line: Column) -> Column:
        return F.lower(F.rtrim(strip(line), F.lit(":：-"))).isin(*headings)

    kept = F.filter(marked, lambda x: ~_is_labeled(x) & ~is_heading(x["line"]))
    return strip(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def labeled_lines(text: Column, pattern: str = terms.LABEL_LINE_PATTERN) -> Column:
    """(label, value) of every ``Label: value`` line, in order."""
    return labels_of(marked_lines(text, pattern))


def first_labeled(labeled: Column, aliases: Sequence[str], max_chars: int = terms.MAX_FIELD_CHARS) -> Column:
    hits = F.filter(labeled, lambda x: x["label"].isin(*aliases) & (x["value"] != ""))
    return F.substring(_first(hits)["value"], 1, max_chars)


def inline_stack(text: Column, max_chars: int = terms.MAX_FIELD_CHARS) -> Column:
    """``Stack: a, b`` inside a line; null when there is none."""
    value = F.regexp_extract(text, terms.INLINE_STACK_PATTERN, 1)
    return F.when(text.rlike(terms.INLINE_STACK_PATTERN), F.substring(strip(value), 1, max_chars))


def labeled_field_columns(
    text: Column, labeled: Column, labels: Mapping[str, Sequence[str]] = terms.FIELD_LABELS
) -> dict[str, Column]:
    fields = {name: first_labeled(labeled, aliases) for name, aliases in labels.items()}
    if "stack" in fields:
        fields["stack"] = F.coalesce(fields["stack"], inline_stack(text))
    return fields


def extract_labeled_fields(text: Column, labels: Mapping[str, Sequence[str]] = terms.FIELD_LABELS) -> Column:
    """Map of the labelled fields a text holds."""

    def as_map(labeled: Column) -> Column:
        fields = labeled_field_columns(text, labeled, labels)
        entries = [F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in fields.items()]
        return F.map_from_entries(F.filter(F.array(*entries), lambda entry: entry["value"].isNotNull()))

    return let(labeled_lines(text), as_map)


def strip_labeled_lines(
    text: Column,
    pattern: str = terms.LABEL_LINE_PATTERN,
    headings: Sequence[str] = terms.FIELD_LABELS["description"],
) -> Column:
    """The text without ``label: value`` lines, known labels or not, and without empty headings."""
    return unlabeled_text(marked_lines(text, pattern), headings)


def guess_title(
    text: Column,
    nouns: Sequence[str] = terms.ROLE_NOUNS,
    pattern: str = terms.TITLE_PATTERN,
    default: str = terms.DEFAULT_TITLE,
) -> Column:
    """A short line naming a role, a role phrase, a line of fitting length, or the default."""
    filled = F.filter(lines(text), lambda line: strip(line) != "")
    heads = F.transform(F.slice(filled, 1, 8), lambda line: strip(line, _BULLETS))

    def choose(heads: Column) -> Column:
        role_lines = F.filter(heads, lambda line: (F.length(line) <= 90) & contains_any(line, nouns))
        fitting = F.filter(F.slice(heads, 1, 5), lambda line: F.length(line).between(8, 90))
        # the phrase pattern is slow on texts that name no role
        phrase = F.when(contains_any(text, nouns), non_blank(collapse(F.regexp_extract(text, pattern, 1))))
        return F.coalesce(_first(role_lines), phrase, _first(fitting), F.lit(default))

    return let(heads, choose)


def guess_location(
    text: Column,
    markers: Sequence[str] = terms.LOCATION_LINE_MARKERS,
    prefix: str = terms.LOCATION_PREFIX_PATTERN,
    places: str = terms.LOCATION_PATTERN,
    remote: Sequence[str] = terms.REMOTE_WORDS,
    remote_label: str = terms.REMOTE_LABEL,
) -> Column:
    """The rest of the first line that speaks of a location, else the first place word."""
    place = non_blank(F.regexp_extract(text, places, 1))
    word = let(place, lambda x: F.when(F.lower(x).isin(*remote), F.lit(remote_label)).otherwise(x))
    named = F.filter(lines(text), lambda line: contains_any(line, markers))

    def from_line(line: Column) -> Column:
        rest = non_blank(F.substring(strip(F.regexp_replace(line, prefix, "")), 1, 120))
        return F.when(line.isNotNull(), rest).otherwise(word)

    return let(_first(named), from_line)


def parse_stack_value(value: Column, **dictionary) -> Column:
    """Listed parts followed by the dictionary hits, each once; only the hits when nothing is listed."""
    parts = F.filter(
        F.transform(F.split(value, r"[,;/|]+"), lambda part: strip(part, _PART_EDGES)),
        lambda part: part != "",
    )
    return ordered_array_union(parts, extract_stack(value, **dictionary))


def ordered_array_union(first: Column, second: Column) -> Column:
    return unique_in_order(F.concat(first, second))


def guess_salary(text: Column, pattern: str = terms.SALARY_PATTERN) -> Column:
    return non_blank(collapse(F.regexp_extract(text, pattern, 1)))


def clean_result_title(title: Column, suffixes: Sequence[str] = terms.TITLE_SUFFIXES) -> Column:
    """The title without the first site suffix it ends with."""
    result = title
    for suffix in reversed(suffixes):
        cut = strip(F.substring(title, F.lit(1), F.length(title) - len(suffix)))
        result = F.when(F.endswith(title, F.lit(suffix)), cut).otherwise(result)
    return result


def strip_hashtags(title: Column, pattern: str = terms.HASHTAG_PATTERN) -> Column:
    bare = F.regexp_replace(F.regexp_replace(title, pattern, ""), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.btrim(bare, F.lit(" -|.,"))


def role_title(text: Column, patterns: Sequence[str] = terms.ROLE_TITLE_PATTERNS) -> Column:
    """The role phrase of the first pattern that matches, null when none does."""

    def clean(role: Column) -> Column:
        bare = F.btrim(role, F.lit(" .,:;!?)("))
        flat = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"(?U)\s+-\s+", "-")
        return let(flat, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))

    def search(flat: Column) -> Column:
        return clean(F.coalesce(*[non_blank(F.regexp_extract(flat, pattern, 1)) for pattern in patterns]))

    return let(collapse(text), search)


def post_title(
    search_title: Column, snippet: Column, patterns: Sequence[str] = terms.ROLE_TITLE_PATTERNS
) -> Column:
    role = role_title(F.concat(search_title, F.lit(". "), snippet), patterns)
    return F.coalesce(non_blank(role), non_blank(strip_hashtags(search_title)), search_title)


def tag_markers(
    text: Column,
    pairs: Sequence[tuple[str, str]] = terms.TAG_MARKERS,
    leading: str = terms.LEADING_TAG,
) -> Column:
    """The leading tag and the label of every marker the text contains, each once."""
    lowered = F.lower(text)
    labels = [F.when(F.contains(lowered, F.lit(marker)), F.lit(label)) for label, marker in pairs]
    return unique_in_order(F.array_compact(F.array(F.lit(leading), *labels)))


def split_queries(raw: Column) -> Column:
    """``a || b`` as its non-empty trimmed parts, in order."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), r"\|\|"), lambda part: strip(part))
    return F.filter(parts, lambda part: part != "")


def error_reason(
    text: Column,
    reasons: Sequence[tuple[str, str]] = terms.ERROR_REASONS,
    default: str = terms.DEFAULT_ERROR_REASON,
) -> Column:
    """Public reason of an error text: first marker it contains; null for no error."""
    normalized = F.lower(collapse(text))
    reason = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
    for marker, public in reasons:
        reason = reason.when(F.contains(normalized, F.lit(marker)), public)
    return reason.otherwise(default)


def safe_error_type(name: Column, max_chars: int = 80) -> Column:
    """Error class name reduced to harmless characters."""
    safe = F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_.]", "_"), 1, max_chars)
    return F.when(safe == "", "Exception").otherwise(safe)
