"""Small hand-made cases of the extraction, date, URL, role and card rules."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions import cards, dates, extract, html, text, urls
from hiremill.functions.identity import fingerprint, identity_source, valid_fingerprint
from hiremill.operators import filters
from hiremill.plans import jobs


def values(spark, expression, inputs, kind="string"):
    """The expression over one column, in input order."""
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def moment(value):
    return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


# ---------------------------------------------------------------- messages
CARD_EN = """🚀 Senior Python Developer
🏢 Company: Blue Ocean
📍 Location: Berlin, hybrid
🧠 Stack: Python, FastAPI / Redis
💰 Salary: €4 000 - €5 500
Description:
Maintain services on Kubernetes.
https://jobs.example.org/42?x=1."""

CARD_RU = """Инженер данных
Компания: Север
Локация: Казань
Стек: Python; Kafka
Зарплата: 200 000 ₽
Описание: Пишем на Python и поддерживаем сервисы."""


def parse(spark, message):
    row = jobs.parse_posts(spark.createDataFrame([(message,)], "text string")).collect()[0]
    return row.asDict()


def test_labelled_message(spark):
    post = parse(spark, CARD_EN)
    assert post["title"] == "🚀 Senior Python Developer"
    assert post["company"] == "Blue Ocean"
    assert post["location"] == "Berlin, hybrid"
    assert post["stack"] == ["Python", "FastAPI", "Redis"]
    assert post["salary"] == "€4 000 - €5 500"
    assert post["description"] == "Maintain services on Kubernetes."
    assert post["url"] == "https://jobs.example.org/42?x=1"
    assert post["source"] == "jobs.example.org"


def test_labelled_message_in_russian(spark):
    post = parse(spark, CARD_RU)
    assert post["title"] == "Инженер данных"
    assert post["company"] == "Север"
    assert post["location"] == "Казань"
    assert post["stack"] == ["Python", "Kafka"]
    assert post["salary"] == "200 000 ₽"
    assert post["description"] == "Пишем на Python и поддерживаем сервисы."
    assert (post["url"], post["source"]) == (None, "Telegram")


def test_stack_needs_evidence(spark):
    stacks = values(
        spark,
        extract.extract_stack_with_evidence,
        [
            "We build APIs with Django. Java is an island.",
            "React is popular.",
            "Experience with MySQL and SQL! Using LLM and QA tools",
            "Using Node.js and Docker",
        ],
    )
    # substrings count, and the sentence ends at the dot of "Node.js"
    assert stacks == [["Django", "Go"], [], ["MySQL"], []]


def test_explicit_stack_wins(spark):
    post = parse(spark, "Backend Developer\nStack: Rust\nWe build services with Python.")
    assert post["stack"] == ["Rust"]


def test_inline_stack(spark):
    post = parse(spark, "QA engineer wanted for a long project\nGood team. Stack: Go, Redis. Apply now")
    assert post["stack"] == ["Go", "Redis"]


def test_title_rules(spark):
    titles = values(
        spark,
        extract.guess_title,
        ["Hello\nFull-stack developer", "hi\n" + "x" * 95 + " qa engineer wanted", "short\nA line of text", "a\nb"],
    )
    assert titles[0] == "Full-stack developer"
    assert titles[1].endswith("qa engineer wanted")
    assert titles[2:] == ["A line of text", "IT Vacancy"]


def test_hyphen_in_title_is_no_label(spark):
    assert values(spark, extract.labeled_lines, ["Back-end Developer"]) == [[]]
    assert values(spark, extract.strip_labeled_lines, ["Developer\nanything here: yes\nDescription:\ntext"]) == [
        "Developer\ntext"
    ]


def test_location_rules(spark):
    found = values(
        spark,
        extract.guess_location,
        ["📍 Локация: Минск", "work remote or Berlin", "Location:", "we trust you", "нигде", "relocation to EU"],
    )
    # "relocation" holds the word of a location line, so the whole line is taken
    assert found == ["Минск", "Удаленно", None, "us", None, "relocation to EU"]


def test_salary_rules(spark):
    found = values(spark, extract.guess_salary, ["from $3 000 - $4 000 net", "до 250 тыс. в месяц", "none", "5k usd"])
    assert found == ["$3 000 - $4 000", "250 тыс.", None, "5k"]


def test_null_texts(spark):
    assert values(spark, extract.extract_stack, [None]) == [[]]
    assert values(spark, lambda x: text.contains_any(x, ["a"]), [None, "A"]) == [False, True]


# ---------------------------------------------------------------- roles
ALLOWED = [
    "Backend Engineer", "Trainee frontend developer", "Automation QA specialist", "DevSecOps lead", "UI/UX artist",
    "Разработчик 1С",
]
DENIED = [
    "Python course for backend people", "Embedded software engineer", "Engineering Manager, backend", "SDET developer",
    "AppSec developer", "Developer support", "Technical writer for developers", "Solutions consultant, React developer",
    "Accountant",
]


def test_role_policy(spark):
    verdicts = values(spark, filters.role_allowed, ALLOWED + DENIED)
    # "devsecops" does not contain the denied "devops"
    assert verdicts == [True] * len(ALLOWED) + [False] * len(DENIED)


def test_intake(spark):
    verdicts = values(
        spark,
        filters.looks_like_posting,
        ["We are hiring a backend developer, write us", "backend dev", "Product manager needed in a big company", None],
    )
    assert verdicts == [True, False, False, False]


# ---------------------------------------------------------------- dates
def test_source_dates(spark):
    found = values(
        spark,
        lambda x: moment(dates.parse_source_datetime(x)),
        [
            "2026-07-05T10:15:00Z", "1783209600", "1783209600000", "Fri, 17 Jul 2026 10:00:00 +0200",
            "17 Jul 2026 10:00 EST", "2026-07-05 10:15:00.5", "20260705", "2026-07-05", "", None, "soon",
            "99999999999999999999999999999999", "2026-13-45", "Jul 5, 2026",
        ],
    )
    assert found == [
        "2026-07-05 10:15:00", "2026-07-05 00:00:00", "2026-07-05 00:00:00", "2026-07-17 08:00:00",
        "2026-07-17 15:00:00", "2026-07-05 10:15:00", "1970-08-23 11:58:25", "2026-07-05 00:00:00",
        None, None, None, None, None, None,
    ]


def test_search_dates(spark):
    found = values(
        spark, lambda x: moment(dates.parse_search_date(x)), ["Jul 5, 2026", "July 5, 2026", "Julia 5, 2026", "3 days ago"]
    )
    assert found == ["2026-07-05 00:00:00"] * 2 + [None, None]


def test_activity_dates(spark):
    found = values(
        spark,
        lambda x: moment(dates.resolve_published_at(F.lit(""), x)),
        [
            "https://www.linkedin.com/posts/a-activity-7483822807449600000-x",
            "https://www.linkedin.com/posts/a-activity-7483822807449600000",
            "https://www.linkedin.com/feed/update/urn:li:activity:7483822807449600000",
            "https://x/activity-99999999999999999999",
            "https://x/activity-12345",
        ],
    )
    assert found[:3] == ["2026-07-17 10:00:00", "2026-07-17 10:00:00", None]
    assert found[3].startswith("2725-") and found[4] is None


@pytest.mark.parametrize("hours,bucket", [(1, "qdr:h"), (24, "qdr:d"), (25, "qdr:w"), (240, "qdr:m"), (745, "qdr:y")])
def test_recency(spark, hours, bucket):
    assert values(spark, dates.recency_bucket, [hours], "int") == [bucket]


def test_freshness_boundary(spark):
    now = datetime(2026, 7, 20, 12, tzinfo=UTC)
    ages = [timedelta(hours=120), timedelta(hours=120, seconds=1), None]
    for kind in ("timestamp", "timestamp_ntz"):
        stamps = [(i, a and (now - a).strftime("%Y-%m-%d %H:%M:%S+00:00")) for i, a in enumerate(ages)]
        rows = spark.createDataFrame(stamps, "i int, s string")
        stamp = F.col("s").cast("timestamp") if kind == "timestamp" else F.substring("s", 1, 19).cast(kind)
        posts = rows.select("i", stamp.alias("published_at"))

        def kept(**options):
            return sorted(r.i for r in filters.filter_fresh(posts, now=now, **options).collect())

        assert kept(max_age_hours=120) == [0, 2]
        assert kept(max_age_hours=120, require_published_at=True) == [0]
        assert kept(max_age_hours=0) == [0, 1, 2]
        assert kept(max_age_hours=0, require_published_at=True) == [0, 1]


def test_dates_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.createDataFrame([("2026-07-05T10:15:00", "2026-07-05 10:15:00")], "a string, b string")
        parsed = rows.select(
            F.unix_seconds(dates.parse_source_datetime(F.col("a"))).alias("a"), F.col("b").cast("timestamp_ntz")
        )
        row = parsed.select("a", dates.epoch_seconds(parsed, "b").alias("b")).collect()[0]
        assert row.a == row.b == int(datetime(2026, 7, 5, 10, 15, tzinfo=UTC).timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# ---------------------------------------------------------------- URLs and pages
def test_canonical_urls(spark):
    found = values(
        spark,
        urls.canonicalize_url,
        [
            "https://de.linkedin.com/posts/anna-123/?utm_source=x#top", "HTTP://LINKEDIN.COM:443/feed/update/u1/",
            "https://linkedin.com.evil.org/posts/a", "https://evil.org/linkedin.com/posts/a", "ftp://linkedin.com/posts/a",
            "https://www.linkedin.com/posts/", "https://www.linkedin.com/jobs/1", "https://evillinkedin.com/posts/a",
            "https://www.linkedin.com@evil.org/posts/a", None,
        ],
    )
    assert found == [
        "https://www.linkedin.com/posts/anna-123", "https://www.linkedin.com/feed/update/u1", *[""] * 8,
    ]


def test_redirects(spark):
    found = values(
        spark,
        urls.unwrap_redirect_url,
        [
            "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc%3Fd%3D1%2B2&rut=1", "//a.b/c", "  https://a.b ", "",
            "/l/?x=1", "/l/?uddg=bad%zz",
        ],
    )
    assert found == ["https://a.b/c?d=1+2", "https://a.b/c", "https://a.b", "", "", "bad%zz"]


def test_sources_by_host(spark):
    found = values(
        spark,
        urls.detect_source,
        ["https://de.linkedin.com/x", "https://t.me/a", "https://www.jobs.org:8080/a", "nothing", "", None],
    )
    assert found == ["LinkedIn", "Telegram", "jobs.org:8080", "External", "Telegram", "Telegram"]


def test_html_text(spark):
    found = values(
        spark,
        html.html_to_text,
        [
            "<p title='a>b'>one<b>two</b></p><!-- no --><script>if (a<b) {}</script>",
            "a &amp;lt; b &#8364;&#x41; &eacute; &unknown; 5 < 6 & 7", None,
        ],
    )
    assert found == ["one two", "a &lt; b €A é &unknown; 5 < 6 & 7", ""]


def test_origin_url(spark):
    rows = spark.createDataFrame([("chan", 5), ("", 5), (None, 5), ("chan", None), ("chan", 0)], "u string, m bigint")
    found = [r.y for r in rows.select(urls.public_origin_url(F.col("u"), F.col("m")).alias("y")).collect()]
    assert found == ["https://t.me/chan/5", None, None, None, None]


def test_forwarded_message_takes_the_origin_url(spark):
    message = "Backend developer wanted, write to our recruiting team"
    rows = spark.createDataFrame(
        [(message.replace("recruiting ", ""), "chan", 7), (message.replace("recruiting ", "") + " https://a.b/c", "chan", 7)],
        "text string, origin_username string, origin_message_id bigint",
    )
    found = {(r.url, r.source) for r in jobs.intake_posts(rows).collect()}
    assert found == {("https://t.me/chan/7", "Telegram"), ("https://a.b/c", "a.b")}


# ---------------------------------------------------------------- titles, tags, cards
def test_titles_of_results(spark):
    assert values(spark, extract.clean_result_title, ["Dev | LinkedIn", "Dev в LinkedIn", "Dev | LinkedIn!"]) == [
        "Dev", "Dev", "Dev | LinkedIn!",
    ]
    found = values(
        spark,
        lambda x: extract.post_title(x, F.lit("")),
        [
            "Ищем ведущий python разработчик в команду", "We need a full-stack engineer (remote)", "#hiring #now Artist -",
            "Engineer Backend wanted",
        ],
    )
    assert found == ["Ведущий python разработчик", "Full-stack engineer", "Artist", "Engineer Backend"]


def test_tags(spark):
    found = values(spark, extract.tag_markers, ["Front-End and REACT on LinkedIn, frontend", "nothing"])
    assert found == [["LinkedIn post", "frontend", "React"], ["LinkedIn post"]]


def test_scalars_and_queries(spark):
    assert values(spark, lambda x: text.clean_scalar(x, terms.EMPTY_SCALARS), [" NaN", None, " a "]) == ["", "", "a"]
    assert values(spark, extract.split_queries, ["a || b||", " ", None]) == [["a", "b"], [], []]


def test_trimming(spark):
    assert values(spark, lambda x: text.trim_text(x, 6), ["a  b\n c", "abcd efgh", "abcdef"]) == [
        "a b c", "abcd...", "abcdef",
    ]
    assert values(spark, lambda x: text.trim_text(x, 3), ["abcdef"]) == ["ab..."]


def test_identity(spark):
    rows = spark.createDataFrame(
        [(" HTTPS://A.B ", "t", "c", "l", "d"), (None, "Dev", " ", "", "x" * 300), ("", "Dev", None, None, "")],
        "url string, title string, company string, location string, description string",
    )
    source = identity_source(*(F.col(c) for c in rows.columns))
    found = [r.y for r in rows.select(source.alias("y")).collect()]
    # a blank part still counts, an empty one does not
    assert found == ["https://a.b", "dev||" + "x" * 240, "dev"]
    prints = [r.y for r in rows.select(fingerprint(source).alias("y")).collect()]
    assert all(len(p) == 32 for p in prints)
    assert values(spark, valid_fingerprint, [prints[0], prints[0] + "\n", "x", None]) == [True, False, False, False]


def test_card(spark):
    row = spark.createDataFrame([("A & B", None, "", "<5>", "  a\n b ", None, "it's")], "t string, c string, l string, s string, d string, u string, o string")
    card = cards.render_card(
        F.col("t"), F.col("c"), F.col("l"), F.col("s"), F.lit(None).cast("array<string>"), F.col("d"), F.col("u"), F.col("o")
    )
    assert row.select(card.alias("y")).collect()[0].y == (
        "💼 <b>A &amp; B</b>\n\n💰 <b>Зарплата</b>: &lt;5&gt;\n\n🧠 <b>Стек</b>: —\n\n<b>Описание</b>\na b\n"
        "▫️ Источник: it&#x27;s"
    )


def test_error_reasons(spark):
    found = values(spark, extract.error_reason, [" LOGIN  is required", "odd", "", None])
    reasons = dict(terms.ERROR_REASONS)
    assert found == [reasons["login is required"], terms.DEFAULT_ERROR_REASON, None, None]
    assert values(spark, extract.safe_error_type, ["Time out!", "", None]) == ["Time_out_", "Exception", "Exception"]


# ---------------------------------------------------------------- references, dates and feeds beyond the common forms
def one_column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_html5_references(spark):
    import html as standard

    from hiremill.functions.html import decode_entities

    cases = [
        "it&apos;s", "&check; &lsqb;", "&#146;&#x80;", "&notit; &amp &ampx &copy2", "&unknown; & &; &#; &#99999999;",
        "&acE;&nbsp;x", "a&lt;b&gt", "AT&T", "&#65;&#x42;",
    ]
    wanted = [standard.unescape(c) for c in cases]
    assert one_column(spark, cases, decode_entities) == wanted


def test_iso_forms(spark):
    from hiremill.functions.dates import parse_source_datetime

    cases = [
        "2026-07-05T10:00:00.1234567Z", "20260705T100000Z", "2026-07-05T10", "2026-07-05T10:00:00,5Z", "2026-W27-1",
        "2026W271T10:30+02:00", "2026-W53-1", "2026-W54-1", "2026-07-05 10:00:00+0530", "2026-13-01", "2026-07-05T25:00",
        "2026-07-05", "2020-W53-7",
    ]
    found = one_column(spark, cases, parse_source_datetime)

    def standard(text):
        try:
            moment = datetime.fromisoformat(text)
        except ValueError:
            return None
        moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
        return moment.astimezone(UTC)

    for text, value in zip(cases, found, strict=True):
        wanted = standard(text)
        assert (value is None) == (wanted is None), text
        if wanted is not None:
            assert value.replace(tzinfo=UTC) == wanted or value.astimezone(UTC) == wanted, text


def test_feeds_with_channels_depth_and_inner_markup(spark):
    from hiremill.sources.feeds import scan_rss_items

    feed = """<?xml version="1.0"?><rss><!-- <item><title>no</title></item> -->
<channel><item><title>a <b>bold</b> c</title><link> http://x/1 </link><description>&lt;p&gt;one &amp;amp; two&lt;/p&gt;</description></item></channel>
<channel><group><item rank="2"><title><![CDATA[x < y & z]]></title><link>http://x/2</link><pubDate>d</pubDate></item></group><item/></channel></rss>"""
    rows = spark.createDataFrame([(1, feed), (2, "<rss><item>"), (3, " "), (4, None)], "k int, rss string")
    found = sorted(tuple(r) for r in scan_rss_items(rows).collect())
    assert found == [
        (1, 1, "a bold c", "http://x/1", "one & two", ""),
        (1, 2, "x < y & z", "http://x/2", "", "d"),
    ]


def test_feeds_are_read_by_depth(spark):
    from xml.etree import ElementTree

    from hiremill.sources.feeds import scan_rss_items

    feeds = [
        "<rss><channel><item><title><![CDATA[a </item> b]]></title><link>http://x/1</link></item></channel></rss>",
        "<rss><channel><item><image><title>logo</title><link>no</link></image><title>real</title><link>l</link></item></channel></rss>",
        "<rss><channel><description><![CDATA[<item><title>ghost</title></item>]]></description><item><title>t</title></item></channel></rss>",
        "<rss><item><title><![CDATA[keep <!-- this --> text]]></title><description>x<!-- not --> y</description></item></rss>",
        "<rss><item><title>outer</title><group><item><title>inner</title></item></group><link>after</link></item></rss>",
        "<rss><item><a><a><title>deep</title></a></a><title/><title>second</title><link>one<b> two</b></link><link>three</link></item></rss>",
        "<!DOCTYPE rss [<!ENTITY x 'y'>]><rss><item a='>'><title k='/item>'>t</title><pubDate> d </pubDate></item></rss>".replace("[<!ENTITY x 'y'>]", ""),
        "<rss><items><item><items/><title>plural</title></item></items></rss>",
        "<rss><item><title>&amp;lt; &#233; &quot;</title></item><item> <title>b</title></item></rss>",
    ]

    def standard(feed):
        rows = []
        for item in ElementTree.fromstring(feed).findall(".//item"):
            child = lambda name: "".join(e.itertext()).strip() if (e := item.find(name)) is not None else ""  # noqa: B023, E731
            rows.append((child("title"), child("link"), child("pubDate")))
        return rows

    table = spark.createDataFrame(list(enumerate(feeds)), "k int, rss string")
    found = scan_rss_items(table).orderBy("k", "position").collect()
    for number, feed in enumerate(feeds):
        own = [(r.title, r.link, r.date_text) for r in found if r.k == number]
        assert own == standard(feed), feed
    assert [r.snippet for r in found if r.k == 3] == ["x y"]


def test_links_skip_comments_scripts_and_guarded_pages(spark):
    from hiremill.sources.pages import page_links

    link = '<a href="https://www.linkedin.com/posts/{}">x</a>'
    page = link.format("a") + "<!-- " + link.format("b") + " --><script>s='" + link.format("c") + "'</script>"
    rows = spark.createDataFrame(
        [(1, page), (2, page + '<input type="password">'), (3, None)], "page_id int, html string"
    )
    found = [(r.page_id, r.url.rsplit("/", 1)[1]) for r in page_links(rows).collect()]
    assert found == [(1, "a")]
