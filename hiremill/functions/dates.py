"""Date expressions. All of them give UTC instants and do not depend on the session time zone."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiremill import terms
from hiremill.functions.text import let, strip

# --- Fixed values: date formats -------------------------------------------
_MAX_EPOCH_SECONDS = 253402300799
_MILLIS_ABOVE = 10_000_000_000
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (
    r"(?=(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b)([a-z]{3})[a-z]*"
)
# parts: year; month and day, with or without hyphens; week and its day; hour, minutes, seconds, fraction,
# with or without colons; offset sign and hours, minutes, seconds
_ISO_DATE = (
    r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-?W(\d{2})(?:-?([1-7]))?)"
    r"(?:[\s\S](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:Z|([+-]\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?)?$"
)
_MAIL_DATE = (
    rf"(?i)^(?:[a-z]{{3,9}},?\s*)?(?:(\d{{1,2}})\s+{_MONTH}|{_MONTH}\s+(\d{{1,2}})),?\s+"
    r"(\d{4}|\d{2})\s+(\d{1,2}:\d{2})(:\d{2})?(?:\s*([+-]\d{4}|[a-z]{1,4}))?(?:\s*\(.*\))?$"
)
_SEARCH_DATE = rf"(?i)^{_MONTH}\s+(\d{{1,2}}),\s*(\d{{4}})$"
_ZONES = {
    "est": "-0500", "edt": "-0400", "cst": "-0600", "cdt": "-0500",
    "mst": "-0700", "mdt": "-0600", "pst": "-0800", "pdt": "-0700",
}


def _instant(date: Column, time: Column, offset: Column) -> Column:
    return F.concat(date, F.lit("T"), time, offset).try_cast("timestamp")


def _month_number(name: Column) -> Column:
    return F.lpad(F.floor((F.instr(F.lit(_MONTHS), F.lower(name)) + 2) / 3).cast("string"), 2, "0")


def from_epoch(text: Column) -> Column:
    """Digits as seconds, or as milliseconds above the threshold; null beyond year 9999."""

    def instant(number: Column) -> Column:
        millis = F.when(number > _MILLIS_ABOVE, number).otherwise(number * 1000)
        return F.when(number < _MAX_EPOCH_SECONDS * 1000, F.timestamp_millis(millis.try_cast("bigint")))

    return let(text.try_cast("decimal(30,0)"), instant)


def from_iso(text: Column) -> Column:
    """ISO-8601 date or date and time, in the extended or the basic form, as a calendar or a week date."""
    parts = F.split(F.regexp_replace(text, _ISO_DATE, "|".join(f"${i}" for i in range(1, 15))), r"\|")

    def or_zero(part: Column) -> Column:
        return F.when(part == "", "00").otherwise(part)

    def instant(part: Column) -> Column:
        year = part[0].cast("int")
        first = F.when(year > 0, F.make_date(year, F.lit(1), F.lit(4)))
        monday = F.date_sub(first, F.weekday(first))
        week = F.nullif(part[5], F.lit("")).cast("int")
        day = F.date_add(monday, (week - 1) * 7 + F.coalesce(F.nullif(part[6], F.lit("")).cast("int"), F.lit(1)) - 1)
        month_day = F.concat_ws("-", part[0], F.concat(part[1], part[3]), F.concat(part[2], part[4]))
        date = F.when(part[5] == "", month_day).otherwise(F.when(F.weekofyear(day) == week, day.cast("string")))
        fraction = F.when(part[10] == "", "").otherwise(F.concat(F.lit("."), F.substring(part[10], 1, 6)))
        time = F.concat(F.concat_ws(":", or_zero(part[7]), or_zero(part[8]), or_zero(part[9])), fraction)
        offset = F.concat_ws(":", F.when(part[11] == "", "+00").otherwise(part[11]), or_zero(part[12]), or_zero(part[13]))
        return _instant(date, time, F.regexp_replace(offset, ":00$", ""))

    return F.when(text.rlike(_ISO_DATE), let(parts, instant))


def from_mail_date(text: Column) -> Column:
    """Dates of mail headers and feeds: ``Fri, 17 Jul 2026 10:00:00 GMT``."""
    parts = F.split(F.regexp_replace(text, _MAIL_DATE, "$5|$2$3|$1$4|$6|$7|$8"), r"\|")
    zones = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])

    def instant(part: Column) -> Column:
        century = F.when(F.length(part[0]) == 4, "").when(part[0] > "68", "19").otherwise("20")
        date = F.concat_ws("-", F.concat(century, part[0]), _month_number(part[1]), F.lpad(part[2], 2, "0"))
        time = F.concat(F.lpad(part[3], 5, "0"), F.when(part[4] == "", ":00").otherwise(part[4]))
        numeric = F.when(part[5].rlike("^[+-]"), part[5]).otherwise(
            F.coalesce(F.try_element_at(zones, F.lower(part[5])), F.lit("+0000"))
        )
        return _instant(date, time, F.regexp_replace(numeric, r"(\d{2})$", ":$1"))

    return F.when(text.rlike(_MAIL_DATE), let(parts, instant))


def _from_search_date(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, _SEARCH_DATE, "$3|$1|$2"), r"\|")

    def instant(part: Column) -> Column:
        date = F.concat_ws("-", part[0], _month_number(part[1]), F.lpad(part[2], 2, "0"))
        return _instant(date, F.lit("00:00:00"), F.lit("+00:00"))

    return F.when(text.rlike(_SEARCH_DATE), let(parts, instant))


def parse_source_datetime(value: Column) -> Column:
    """Epoch digits, ISO-8601 or mail date; anything without a zone is UTC."""

    def parse(text: Column) -> Column:
        return F.when(text.rlike(r"^[0-9]+$"), from_epoch(text)).otherwise(
            F.coalesce(from_iso(text), from_mail_date(text))
        )

    return let(strip(value), parse)


def parse_search_date(value: Column) -> Column:
    """Also the forms of search results: ``Jul 5, 2026`` and ``July 5, 2026``."""
    return F.coalesce(parse_source_datetime(value), _from_search_date(value))


def timestamp_from_activity_id(link: Column, pattern: str = terms.ACTIVITY_ID_PATTERN) -> Column:
    """The high bits of a post id are milliseconds since the epoch."""
    digits = F.nullif(F.regexp_extract(link, pattern, 1), F.lit(""))
    millis = F.floor(digits.cast("decimal(20,0)") / F.lit(4194304).cast("decimal(20,0)"))
    return F.timestamp_millis(millis.cast("bigint"))


def resolve_published_at(date_text: Column, link: Column) -> Column:
    return F.coalesce(parse_search_date(date_text), timestamp_from_activity_id(link))


def recency_bucket(hours: Column) -> Column:
    return (
        F.when(hours <= 1, "qdr:h")
        .when(hours <= 24, "qdr:d")
        .when(hours <= 24 * 7, "qdr:w")
        .when(hours <= 24 * 31, "qdr:m")
        .otherwise("qdr:y")
    )


def wall_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less UTC time."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 of an instant or a zone-less UTC column."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return wall_seconds(F.col(name))
    return F.unix_seconds(F.col(name))


def cycle_number(df: DataFrame, name: str, seconds: int = terms.CYCLE_SECONDS) -> Column:
    """Number of the tumbling cycle a timestamp column falls into."""
    return F.floor(epoch_seconds(df, name) / seconds)


def as_utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def moment_literal(moment: datetime, like: T.DataType) -> Column:
    """A UTC moment as a literal of the column's own timestamp type, so the comparison needs no cast."""
    moment = as_utc(moment)
    if isinstance(like, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'")
    micros = (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))
