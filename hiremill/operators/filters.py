"""Filters and validation predicates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions import dates
from hiremill.functions.similarity import too_similar
from hiremill.functions.text import collapse, contains_any, let, script_below, script_reached, strip


def role_text(title: str = "title", description: str = "description") -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(description), F.lit("")))


def role_allowed(
    text: Column,
    allow: Sequence[str] = terms.ALLOWED_ROLE_TERMS,
    deny: Sequence[str] = terms.DENIED_ROLE_TERMS,
    *,
    mode: str = "substring",
) -> Column:
    return contains_any(text, allow, mode=mode) & ~contains_any(text, deny, mode=mode)


def filter_role_policy(
    posts: DataFrame,
    allow: Sequence[str] = terms.ALLOWED_ROLE_TERMS,
    deny: Sequence[str] = terms.DENIED_ROLE_TERMS,
    *,
    mode: str = "substring",
) -> DataFrame:
    return posts.filter(role_allowed(role_text(), allow, deny, mode=mode))


def filter_it_broad(posts: DataFrame, allow: Sequence[str] = terms.BROAD_IT_TERMS) -> DataFrame:
    return filter_role_policy(posts, allow)


def looks_like_posting(text: Column, min_chars: int = terms.MIN_INTAKE_CHARS, **policy) -> Column:
    """Intake test of a raw message: long enough and a wanted role."""
    flat = collapse(F.coalesce(text, F.lit("")))
    return let(flat, lambda t: (F.length(t) >= min_chars) & role_allowed(t, **policy))


def filter_intake(messages: DataFrame, text: str = "text", **options) -> DataFrame:
    return messages.filter(looks_like_posting(F.col(text), **options))


def is_fresh(
    posts: DataFrame,
    *,
    now: datetime,
    max_age_hours: int,
    require_published_at: bool = False,
    column: str = "published_at",
) -> Column:
    """Not older than the limit (the limit itself counts as fresh); undated posts pass unless refused."""
    published = F.col(column)
    if max_age_hours <= 0:
        return published.isNotNull() if require_published_at else F.lit(True)
    cutoff = dates.moment_literal(now - timedelta(hours=max_age_hours), posts.schema[column].dataType)
    fresh = published >= cutoff
    return fresh if require_published_at else fresh | published.isNull()


def filter_fresh(posts: DataFrame, **options) -> DataFrame:
    return posts.filter(is_fresh(posts, **options))


def localization_reason(
    original: Column,
    localized: Column,
    *,
    script: str = terms.CYRILLIC,
    letters: str = terms.LATIN + terms.CYRILLIC,
    min_ratio: float = terms.MIN_SCRIPT_RATIO,
    max_similarity: float = terms.MAX_ORIGINAL_SIMILARITY,
    reasons: Sequence[str] = terms.LOCALIZATION_REASONS,
    translate: Column | None = None,
) -> Column:
    """Why a localized text is refused (empty, not in the target script, too similar); null accepts it.

    ``translate`` says whether the original needs a translation where that is known already.
    """
    empty, wrong_script, copied = reasons
    present = F.coalesce(localized, F.lit("")) != ""
    if translate is None:
        translate = script_below(original, script, letters, min_ratio)
    in_script = script_reached(localized, script, letters, min_ratio)
    repeated = too_similar(original, localized, present & translate & in_script, max_similarity)
    return (
        F.when(~present, empty)
        .when(~translate, F.lit(None).cast("string"))
        .when(~in_script, wrong_script)
        .when(repeated, copied)
    )


def needs_localization(
    text: Column,
    *,
    enabled: bool = True,
    script: str = terms.CYRILLIC,
    letters: str = terms.LATIN + terms.CYRILLIC,
    min_ratio: float = terms.MIN_SCRIPT_RATIO,
) -> Column:
    if not enabled:
        return F.lit(False)
    filled = strip(F.coalesce(text, F.lit(""))) != ""
    return filled & script_below(text, script, letters, min_ratio)


def upload_reason(
    operator: Column,
    chat_type: Column,
    file_name: Column,
    file_size: Column,
    *,
    operators: Sequence[int],
    max_bytes: int,
    extensions: Sequence[str] = terms.RESUME_EXTENSIONS,
) -> Column:
    """First reason to refuse an uploaded resume; null accepts it."""
    safe_name = rf"(?i)^[^/]+\.(?:{'|'.join(extensions)})\z"
    size = F.coalesce(file_size, F.lit(0))
    return (
        F.when(~F.coalesce(operator.isin(*operators), F.lit(False)), "unauthorized")
        .when(F.coalesce(chat_type, F.lit("")) != "private", "not_private")
        .when(F.coalesce(file_name, F.lit("")) == "", "no_document")
        .when(~file_name.rlike(safe_name), "bad_name")
        .when(size > max_bytes, "too_large")
    )


def profile_gaps(
    full_name: Column, email: Column, resume: Column, labels: Sequence[str] = terms.PROFILE_GAPS
) -> Column:
    """What a profile still lacks: two words of a name, an email, a resume."""
    name, mail, file = labels
    words = F.size(F.split(collapse(F.coalesce(full_name, F.lit(""))), " "))
    return F.array_compact(
        F.array(
            F.when(words < 2, name),
            F.when(F.coalesce(email, F.lit("")) == "", mail),
            F.when(F.coalesce(resume, F.lit("")) == "", file),
        )
    )
