"""What makes two posts the same post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiremill.functions.text import blank_to_null, strip

IDENTITY_DESCRIPTION_CHARS = 240
FINGERPRINT_CHARS = 32
FINGERPRINT_PATTERN = r"^[0-9a-f]{32}\z"


def identity_source(url: Column, title: Column, company: Column, location: Column, description: Column) -> Column:
    """The URL if there is one, else the non-empty describing fields joined by '|'."""
    head = F.substring(description, 1, IDENTITY_DESCRIPTION_CHARS)
    fields = [F.lower(strip(blank_to_null(field))) for field in (title, company, location, head)]
    return F.coalesce(F.lower(strip(blank_to_null(url))), F.concat_ws("|", *fields))


def fingerprint(identity: Column) -> Column:
    return F.substring(F.sha2(identity, 256), 1, FINGERPRINT_CHARS)


def post_fingerprint() -> Column:
    """Fingerprint of a row of the posts table."""
    names = ("url", "title", "company", "location", "description")
    return fingerprint(identity_source(*(F.col(name) for name in names)))


def valid_fingerprint(value: Column) -> Column:
    return F.coalesce(value.rlike(FINGERPRINT_PATTERN), F.lit(False))


def application_id(operator: Column, vacancy: Column) -> Column:
    """Stable id of an (operator, post) pair: a retried task gives the same id."""
    return F.substring(F.sha2(F.concat_ws("|", operator.cast("string"), vacancy), 256), 1, 16)
