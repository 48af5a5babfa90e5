"""Column expressions against the standard library on random texts."""

from __future__ import annotations

import html as html_module
import random
import re
from datetime import UTC, datetime
from email.utils import format_datetime, parsedate_to_datetime
from urllib.parse import quote, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions import dates, extract, html, text, urls

SPACES = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　"]


def evaluate(spark, expression, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").repartition(4, "i")
    found = rows.select("i", expression(F.col("x")).alias("y")).collect()
    return [row.y for row in sorted(found, key=lambda r: r.i)]


def random_texts(seed, pieces, n=400, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(longest))) for _ in range(n)]


def check(inputs, found, expected):
    assert [(a, b, c) for a, b, c in zip(inputs, found, expected, strict=True) if b != c] == []


def test_whitespace(spark):
    inputs = random_texts(1, [*SPACES, "a", "Я", "é", "-"])
    check(inputs, evaluate(spark, text.strip, inputs), [x.strip() for x in inputs])
    check(inputs, evaluate(spark, text.collapse, inputs), [" ".join(x.split()) for x in inputs])
    found = evaluate(spark, lambda x: F.filter(text.lines(x), lambda line: line != ""), inputs)
    check(inputs, found, [[line for line in x.splitlines() if line] for x in inputs])


def test_trim_text(spark):
    inputs = random_texts(2, ["a", " ", "  ", "b\n", "длинно"], longest=30)
    for limit in (2, 9, 20):

        def cut(x, limit=limit):
            flat = " ".join(x.split())
            return flat if len(flat) <= limit else flat[: limit - 1].rstrip() + "..."

        check(inputs, evaluate(spark, lambda x: text.trim_text(x, limit), inputs), [cut(x) for x in inputs])


def test_terms(spark):
    inputs = random_texts(3, ["dev", "ops", "De", "v", "курс", "К", "урс", " ", "sre", "s", "re", "back", "end", "-"])
    words = ("devops", "dev", "курс", "sre", "back-end", "back end")
    found = evaluate(spark, lambda x: text.contains_any(x, words), inputs)
    check(inputs, found, [any(w in x.lower() for w in words) for x in inputs])


def test_stack(spark):
    inputs = random_texts(4, [*terms.TECH_KEYWORDS, " ", ",", "My", "Postgre", "script"], longest=8)

    def hits(x):
        found = [w for w in terms.TECH_KEYWORDS if w.lower() in x.lower()]
        if {"PostgreSQL", "MySQL"} & set(found):
            found = [w for w in found if w != "SQL"]
        return found

    check(inputs, evaluate(spark, extract.extract_stack, inputs), [hits(x) for x in inputs])


def test_script_counts(spark):
    inputs = random_texts(5, ["a", "Z", "я", "Ѐ", "ӿ", "é", "1", " ", "-"])
    found = evaluate(spark, lambda x: text.count_chars(x, terms.CYRILLIC), inputs)
    check(inputs, found, [len(re.findall("[Ѐ-ӿ]", x)) for x in inputs])
    found = evaluate(spark, text.comparable_text, inputs)
    check(inputs, found, [" ".join(re.findall("[a-zA-ZЀ-ӿ0-9]+", x.lower())) for x in inputs])


def test_url_parts(spark):
    pieces = ["http", "https", "://", ":", "/", "//", "a.b", "www.", "user@", ":80", "?q=1", "#f", "t.me", "%20", "x"]
    inputs = [x for x in random_texts(6, pieces, n=600, longest=7) if "[" not in x]
    check(inputs, evaluate(spark, urls.authority, inputs), [urlsplit(x).netloc.lower() for x in inputs])
    expected = []
    for x in inputs:
        try:
            expected.append((urlsplit(x).hostname or "").lower())
        except ValueError:
            expected.append("")
    check(inputs, evaluate(spark, urls.hostname, inputs), expected)


def test_canonical_urls(spark):
    pieces = [
        "http://", "https://", "HTTPS://", "ftp://", "linkedin.com", "www.", "de.", "evil", "user:pw@", ":443", "/posts/",
        "/feed/update/", "/", "x-1", "?a=b", "#c", " ", ".org",
    ]
    inputs = random_texts(7, pieces, n=1500, longest=7)
    inputs += [f"{a}{b}linkedin.com{c}{d}" for a in pieces[:4] for b in pieces[5:9] for c in pieces[9:13] for d in pieces[10:17]]

    def canonical(link):
        parts = urlsplit(link.strip())
        host = (parts.hostname or "").lower()
        path = parts.path.rstrip("/")
        fits = parts.scheme in ("http", "https") and (host == "linkedin.com" or host.endswith(".linkedin.com"))
        deep = any(path.startswith(p) and len(path) > len(p) for p in terms.POST_PATH_PREFIXES)
        return f"https://www.linkedin.com{path}" if fits and deep else ""

    expected = [canonical(x) for x in inputs]
    assert sum(bool(e) for e in expected) > 20
    check(inputs, evaluate(spark, urls.canonicalize_url, inputs), expected)


def test_percent_decoding(spark):
    inputs = random_texts(8, ["%", "%41", "%d0%bf", "+", "a", "%zz", "%2", "&", "я", "%25"])
    found = evaluate(spark, lambda x: urls.percent_decode(x, plus_is_blank=False), inputs)
    check(inputs, found, [unquote(x) for x in inputs])
    found = evaluate(spark, lambda x: urls.percent_decode(x, plus_is_blank=True), inputs)
    check(inputs, found, [unquote(x.replace("+", " ")) for x in inputs])


def test_redirects_round_trip(spark):
    targets = [f"https://a.b/{x}" for x in random_texts(9, ["x", "+", "?q=", "&", "я", "#", "=", "-"], n=100)]
    wrapped = [f"//duckduckgo.com/l/?kh=1&uddg={quote(quote(t, safe=''), safe='')}&rut=2" for t in targets]
    check(wrapped, evaluate(spark, urls.unwrap_redirect_url, wrapped), [t.strip() for t in targets])


def test_entities(spark):
    pieces = ["&amp;", "&lt;", "&#65;", "&#x42;", "&eacute;", "&nbsp;", "&", ";", "a ", "&#8364;", "&quot", " ", "&copy"]
    inputs = random_texts(10, pieces)
    # a name directly followed by letters is another, unknown name here
    inputs = [x for x in inputs if not re.search(r"&(quot|copy)a", x)]
    found = evaluate(spark, html.decode_entities, inputs)
    check(inputs, found, [html_module.unescape(x) for x in inputs])


def _stdlib_date(value):
    value = value.strip()
    if not value:
        return None
    try:
        if value.isdigit():
            number = int(value)
            return datetime.fromtimestamp(number / 1000 if number > 10_000_000_000 else number, UTC)
        try:
            moment = datetime.fromisoformat(value)
        except ValueError:
            moment = parsedate_to_datetime(value)
    except (ValueError, OverflowError, OSError, TypeError):
        return None
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


@pytest.mark.parametrize("seed", [11, 12])
def test_dates(spark, seed):
    rng = random.Random(seed)
    inputs = []
    for _ in range(300):
        moment = datetime.fromtimestamp(rng.randrange(0, 4_000_000_000), UTC)
        inputs += [
            moment.isoformat(), moment.strftime("%Y-%m-%dT%H:%M:%SZ"), moment.strftime("%Y-%m-%d %H:%M"),
            moment.strftime("%Y-%m-%d"), moment.strftime("%Y-%m-%dT%H:%M:%S.%f+0530"), format_datetime(moment),
            format_datetime(moment, usegmt=True), moment.strftime("%d %b %Y %H:%M:%S -0330"),
            moment.strftime("%a, %d %b %y %H:%M"), moment.strftime("%A, %d %B %Y %H:%M:%S EDT"),
            str(int(moment.timestamp())), str(int(moment.timestamp()) * 1000), moment.strftime("%b %d %Y"),
            moment.strftime("%Y-%m-31"), moment.strftime("%Y-%m-%dT25:00:00"), moment.strftime("31 %b %Y %H:%M:%S +0000"),
        ]
    found = evaluate(spark, lambda x: F.unix_micros(dates.parse_source_datetime(x)), inputs)
    expected = [_stdlib_date(x) for x in inputs]
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    wanted = [e and (e - epoch).days * 86_400_000_000 + (e - epoch).seconds * 1_000_000 + (e - epoch).microseconds for e in expected]
    check(inputs, found, wanted)
