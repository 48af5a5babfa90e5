"""URL expressions. Hosts and paths are read by pattern, so odd URLs give '' instead of errors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.text import contains_any, let, strip

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_WEB_URL = r"(?i)^https?://([^/?#]*)([^?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)"


def extract_urls(text: Column, pattern: str = terms.URL_PATTERN) -> Column:
    """URLs of the text without trailing '.,;', each once, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;"))))


def authority(url: Column) -> Column:
    """Lowercase authority part, port and user included."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def hostname(url: Column) -> Column:
    return _host_of(F.regexp_extract(url, _AUTHORITY, 1))


def _host_of(netloc: Column) -> Column:
    return F.lower(F.regexp_extract(netloc, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def detect_source(
    url: Column,
    known: Sequence[tuple[str, str]] = terms.SOURCE_HOSTS,
    missing: str = terms.MESSAGE_SOURCE,
    unknown: str = terms.UNKNOWN_SOURCE,
) -> Column:
    host = F.regexp_replace(authority(url), r"^www\.", "")
    label = F.when(F.coalesce(url, F.lit("")) == "", missing)
    for part, source in known:
        label = label.when(F.contains(host, F.lit(part)), source)
    return label.when(host == "", unknown).otherwise(host)


def domain_allowed(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one of them."""
    return _below(hostname(url), domains)


def _below(host: Column, domains: Sequence[str]) -> Column:
    pattern = "|".join(re.escape(domain) for domain in domains)
    return F.coalesce(host.rlike(rf"^(?:.*\.)?(?:{pattern})\z"), F.lit(False))


def canonicalize_url(
    link: Column,
    site: str = terms.POST_SITE,
    prefixes: Sequence[str] = terms.POST_PATH_PREFIXES,
) -> Column:
    """Canonical address of a post page of the site, '' for anything else."""
    value = F.regexp_replace(strip(F.coalesce(link, F.lit(""))), r"[\t\r\n]", "")
    on_site = _below(_host_of(F.regexp_extract(value, _WEB_URL, 1)), [site])

    def page(path: Column) -> Column:
        on_path = F.lit(False)
        for prefix in prefixes:
            on_path = on_path | (F.startswith(path, F.lit(prefix)) & (F.length(path) > len(prefix)))
        return F.when(on_path, F.concat(F.lit(f"https://www.{site}"), path)).otherwise("")

    path = F.rtrim(F.regexp_extract(value, _WEB_URL, 2), F.lit("/"))
    return F.when(on_site, let(path, page)).otherwise("")


def is_post_url_loose(link: Column, markers: Sequence[str] = terms.POST_URL_MARKERS) -> Column:
    return contains_any(link, markers)


def percent_decode(text: Column, *, plus_is_blank: bool) -> Column:
    """Percent decoding that leaves malformed escapes as they are."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_blank:
        safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(safe)


def unwrap_redirect_url(href: Column, path: str = "/l/", parameter: str = "uddg") -> Column:
    """Target of a search-engine redirect link; other links come back trimmed."""
    href = F.coalesce(href, F.lit(""))
    raw = F.regexp_extract(href, rf"^[^?#]*\?(?:[^#]*?&)?{parameter}=([^&#]+)", 1)
    target = percent_decode(percent_decode(raw, plus_is_blank=True), plus_is_blank=False)
    return (
        F.when(F.regexp_extract(strip(href), _PATH, 1) == path, strip(target))
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href))
        .otherwise(strip(href))
    )


def public_origin_url(username: Column, message_id: Column, prefix: str = terms.ORIGIN_PREFIX) -> Column:
    known = (F.coalesce(username, F.lit("")) != "") & (F.coalesce(message_id, F.lit(0)) != 0)
    return F.when(known, F.concat(F.lit(prefix), username, F.lit("/"), message_id.cast("string")))
