"""Operators against brute force on small random tables, and their edge cases."""

from __future__ import annotations

import random
import tracemalloc
from datetime import UTC, datetime, timedelta
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.similarity import text_similarity
from hiremill.operators import aggregates, applications, dedupe, discovery, filters, joins, localization, ordering
from hiremill.operators import profiles, sets
from hiremill.sources.ledger import evolve_ledger, lookup_published_url, rows_to_publish
from hiremill.sources.dom import PAGES_AT_ONCE, first_texts
from hiremill.sources.pages import page_main_text, scan_result_pages
from hiremill.sources.payloads import scan_search_results
from hiremill.plans import jobs
from hiremill.sources.feeds import scan_rss_items
from hiremill.sources.messages import scan_messages
from hiremill.sources.registry import SourceRegistry


def pairs(df, *names):
    return sorted(tuple(row[n] for n in names) for row in df.collect())


# ---------------------------------------------------------------- first n per key
@pytest.mark.parametrize("n", [0, 1, 3, 1500])
def test_first_n_with_one_hot_key(spark, n):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 7919 % 6000) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, ord int")
    expected = []
    for key in {k for k, _ in rows}:
        expected += [(key, o) for o in sorted(o for k, o in rows if k == key)[:n]]
    assert pairs(dedupe.first_n(df, ["key"], [F.col("ord")], n), "key", "ord") == sorted(expected)


def test_new_posts_are_unseen_and_unique(spark):
    posts = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")], "position int, fingerprint string"
    )
    ledger = spark.createDataFrame([("c",), ("z",)], "fingerprint string")
    assert pairs(dedupe.new_posts(posts, ledger, [F.col("position")]), "position") == [(1,), (2,)]
    assert pairs(sets.only_new(posts, ledger), "fingerprint") == [("a",), ("b",)]


# ---------------------------------------------------------------- quotas, rotation, caps
@pytest.mark.parametrize(
    "total,n,expected",
    [(0, 3, [0, 0, 0]), (-5, 3, [0, 0, 0]), (2, 4, [1, 1, 0, 0]), (10, 3, [4, 3, 3]), (12, 3, [4, 4, 4])],
)
def test_fair_quota(spark, total, n, expected):
    intents = spark.createDataFrame([("c", i) for i in range(1, n + 1)], "cycle string, intent_pos int")
    assert [q for _, q in pairs(discovery.fair_quota(intents, total, ["cycle"]), "intent_pos", "quota")] == expected


def rotation(spark, n, k, cycles):
    intents = [(i + 1, f"f{i}", "en", f"q{i}") for i in range(n)]
    rows = spark.createDataFrame([(c,) for c in cycles], "cycle bigint")
    found = discovery.rotate_intents(rows, k, intents)
    return {c: [q for cc, _, q in pairs(found, "cycle", "slot", "query") if cc == c] for c in cycles}


def test_rotation(spark):
    four = rotation(spark, 24, 6, range(4))
    assert sorted(q for queries in four.values() for q in queries) == sorted(f"q{i}" for i in range(24))
    assert rotation(spark, 5, 2, [2]) == {2: ["q4", "q0"]}
    assert rotation(spark, 3, 9, [1]) == {1: ["q0", "q1", "q2"]}
    assert rotation(spark, 3, 0, [1]) == {1: []}
    assert rotation(spark, 3, 2, [-4]) == {-4: ["q0", "q1"]}


def test_default_profile():
    intents = terms.default_intents()
    assert [i[0] for i in intents] == list(range(1, 25))
    assert {i[2] for i in intents} == {"en", "ru"} and len({i[1] for i in intents}) == 12


def one_shot(posts, seen, cap):
    """The loop a single process would run."""
    published: list[str] = []
    for rank in sorted({p[0] for p in posts}):
        if len(published) >= cap:
            break
        source = sorted(p for p in posts if p[0] == rank)
        for _, position, fp in source[: cap - len(published)]:
            if fp not in seen and fp not in [f for f, _ in published]:
                published.append((fp, position))
    return sorted(published)


@pytest.mark.parametrize("seed", range(4))
def test_cap_then_dedupe(spark, seed):
    rng = random.Random(seed)
    posts = [(i % 3, i, f"f{rng.randrange(25)}") for i in range(90)]
    seen = {f"f{i}" for i in range(0, 25, 3)}
    df = spark.createDataFrame(posts, "source_rank int, position int, fingerprint string")
    ledger = spark.createDataFrame([(f,) for f in seen], "fingerprint string")
    for cap in (1, 7, 13):
        found = pairs(discovery.cap_then_dedupe(df, ledger, cap), "fingerprint", "position")
        assert found == one_shot(posts, seen, cap)
    assert len(pairs(discovery.cap_then_dedupe(df, ledger, 0), "fingerprint")) == len({p[2] for p in posts} - seen)


def news(rows):
    kept = []
    for cycle in sorted({r[0] for r in rows}):
        seen: set[str] = set()
        for intent in sorted({r[1] for r in rows if r[0] == cycle}):
            for provider in sorted({r[2] for r in rows if r[:2] == (cycle, intent)}):
                answer: list[tuple] = []
                for row in sorted(r for r in rows if r[:3] == (cycle, intent, provider)):
                    if row[4] not in [a[4] for a in answer] and len(answer) < intent:
                        answer.append(row)
                fresh = [a for a in answer if a[4] not in seen]
                if fresh:
                    seen.update(a[4] for a in fresh)
                    kept += fresh
                    break
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_first_provider_with_news(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 4, rng.randrange(1, 9), rng.randrange(2), i, f"u{rng.randrange(12)}") for i in range(160)]
    df = spark.createDataFrame(
        rows, "cycle int, intent_pos int, provider_rank int, position int, url string"
    ).withColumn("provider", F.lit("p"))
    quotas = spark.createDataFrame([(c, i, i) for c in range(4) for i in range(1, 9)], "cycle int, intent_pos int, quota int")
    found = discovery.first_provider_with_news(df, quotas)
    assert pairs(found, "cycle", "intent_pos", "provider_rank", "position", "url") == news(rows)


def test_priority(spark):
    now = datetime(2026, 7, 20, tzinfo=UTC)
    rows = [
        (1, "stale", now - timedelta(days=30)), (2, "undated", None), (3, "fresh", now - timedelta(hours=5)),
        (4, "fresher", now - timedelta(hours=1)), (5, "undated2", None), (6, "fresh", now - timedelta(minutes=1)),
    ]
    df = spark.createDataFrame(rows, "position int, url string, published_at timestamp")
    best = ordering.prioritize(df, now=now, max_age_hours=24).collect()
    assert [r.url for r in best] == ["fresh", "fresher", "fresh", "undated", "undated2", "stale"]
    top = ordering.top_urls(df, 3, now=now, max_age_hours=24).collect()
    assert [(r.url, r.position) for r in top] == [("fresh", 6), ("fresher", 4), ("undated", 2)]
    assert ordering.top_urls(df, 0, now=now, max_age_hours=24).count() == 0
    assert ordering.limit_wanted(df, -3, ["position"]).count() == 0
    assert ordering.publish_cap(df, 0, ["position"]).count() == 6
    assert [r.omitted for r in ordering.show_with_omitted(df, 9, ["position"]).collect()][-1] == 0


# ---------------------------------------------------------------- joins
def test_term_match(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "abcd", "abcde", "b", "c#", "node.js", "разработчик", "разраб", "cdabcdabcd", "zz"]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ["Senior РАЗРАБОТЧИК", "Node.js and C#", "", "line\nbreak ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    dictionary = spark.createDataFrame([(w,) for w in words], "term string")
    expected = sorted((i, w) for i, t in enumerate(texts) for w in words if w in t.lower())
    assert pairs(joins.term_match(rows, dictionary, key="k"), "k", "term") == expected


def test_term_match_takes_terms_of_any_length(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(500))
    rows = spark.createDataFrame([(1, text), (2, text[:100]), (3, None), (4, "")], "k int, text string")
    terms_ = [text[i : i + n] for i, n in ((0, 1), (3, 2), (5, 3), (7, 70), (2, 200), (0, 500))]
    found = pairs(joins.term_match(rows, spark.createDataFrame([(t,) for t in terms_], "term string"), key="k"), "k", "term")
    assert found == sorted({(k, t) for k, x in ((1, text), (2, text[:100])) for t in terms_ if t in x})


def test_authorized_modes(spark):
    df = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    assert joins.authorized_only(df, [2]).count() == 1
    assert joins.authorized_only(df, []).count() == 2
    assert joins.authorized_only(df, [], when_empty="nobody").count() == 0
    with pytest.raises(ValueError):
        joins.authorized_only(df, [], when_empty="some")


def test_resume_name_follows_its_file(spark):
    configured = spark.createDataFrame(
        [(1, "own.pdf", "f"), (2, "own.pdf", " "), (3, "own.pdf", "f")],
        "operator_user_id bigint, resume_original_name string, resume_file_id string",
    )
    stored = spark.createDataFrame(
        [(1, "new.pdf", "g"), (2, "lost.pdf", ""), (9, "x.pdf", "x")],
        "operator_user_id bigint, resume_original_name string, resume_file_id string",
    )
    found = joins.profile_with_defaults(configured, stored)
    assert sorted(tuple(r) for r in found.select("operator_user_id", "resume_original_name", "resume_file_id").collect()) == [
        (1, "new.pdf", "g"), (2, "own.pdf", None), (3, "own.pdf", "f"),
    ]


# ---------------------------------------------------------------- ledgers and profiles
def test_ledger_rows(spark):
    fp = "0" * 31
    posts = spark.createDataFrame(
        [(1, fp + "1", "t1", "s", "u"), (2, fp + "1", "t2", "s", "u"), (3, fp + "2", "t3", "s", None)],
        "k int, fingerprint string, title string, source string, url string",
    )
    ledger = spark.createDataFrame([(fp + "2", "t", "s", None)], "fingerprint string, title string, source string, url string")
    assert pairs(rows_to_publish(posts, ledger, [F.col("k")]), "title") == [("t1",)]
    asked = spark.createDataFrame([(1, fp + "2"), (2, fp + "3"), (3, "x"), (4, fp + "2 ")], "i int, vacancy_id string")
    known = ledger.withColumn("url", F.lit("http://a"))
    assert pairs(lookup_published_url(asked, known).na.fill("-"), "i", "published_url") == [
        (1, "http://a"), (2, "-"), (3, "-"), (4, "-"),
    ]
    merged = evolve_ledger(ledger.select("fingerprint"), ledger.withColumn("note", F.lit(1)))
    assert merged.columns == ["fingerprint", "title", "source", "url", "note"] and merged.count() == 2


def test_insert_applications(spark):
    a, b, c = "a" * 32, "b" * 32, "c" * 32
    ledger = spark.createDataFrame(
        [(a, "t", "s", "https://Jobs.Example.org:8080/x"), (b, "t", "s", None), (c, "t", "s", "https://c.org/1")],
        "fingerprint string, title string, source string, url string",
    )
    requests = spark.createDataFrame(
        [(1, a), (1, a), (1, b), (2, c), (1, "d" * 32), (1, "A" * 32), (2, a)],
        "operator_user_id bigint, vacancy_id string",
    )
    existing = spark.createDataFrame([(2, a)], "operator_user_id bigint, vacancy_fingerprint string")
    found = applications.insert_applications(requests, ledger, existing)
    assert pairs(found.na.fill("-"), "operator_user_id", "vacancy_fingerprint", "site", "status", "error_description") == [
        (1, a, "jobs.example.org:8080", "created", "-"), (1, b, "-", "failed", terms.NO_URL_ERROR), (2, c, "c.org", "created", "-"),
    ]
    ids = [r.application_id for r in found.collect()]
    assert len(set(ids)) == 3 and all(len(i) == 16 for i in ids)


def test_profiles(spark):
    fields = ["full_name", "email"]
    current = spark.createDataFrame(
        [(1, 0, "A B", "a@b"), (2, 0, "C D", None)], "operator_user_id bigint, version bigint, full_name string, email string"
    )
    changes = spark.createDataFrame(
        [(1, 5, "A Z", None), (1, 3, "A Y", "y@b"), (3, 4, "N", "n@b")], current.schema
    )
    full = profiles.upsert_profiles(current, changes, fields)
    assert sorted(tuple(r) for r in full.na.fill("-").collect()) == [
        (1, "A Z", "-", 0, 5), (2, "C D", "-", 0, 0), (3, "N", "n@b", 4, 4),
    ]
    patches = spark.createDataFrame(
        [(1, 2, "email", None), (1, 1, "email", "x"), (2, 7, "full_name", "E")],
        "operator_user_id bigint, version bigint, field string, value string",
    )
    patched = profiles.patch_profiles(current, patches, fields)
    assert sorted(tuple(r) for r in patched.na.fill("-").collect()) == [(1, "A B", "-", 0, 2), (2, "E", "-", 0, 7)]


def test_extra_fields(spark):
    names = [(1, i, f"n{i % 25}: v{i}") for i in range(60)]
    odd = [(2, 1, "no colon"), (2, 2, " : x"), (2, 3, "x: "), (2, 4, "a: b: c"), (2, 5, "n" * 65 + ": v"), (2, 6, "n: " + "v" * 257)]
    df = spark.createDataFrame(names + odd, "owner int, seq int, text string")
    found = {r.owner: r.extra_fields for r in profiles.parse_extra_fields(df, "owner", "seq").collect()}
    kept: dict[str, str] = {}
    for _, _, entry in names:
        name, value = entry.split(": ")
        if name in kept or len(kept) < 20:
            kept[name] = value
    assert found == {1: kept, 2: {"a": "b: c"}}
    stored = spark.createDataFrame([('{"a": "b"}',), ('{"a": 1}',), ("[]",), ("oops",), (None,)], "j string")
    assert [r.y for r in stored.select(profiles.extra_fields_valid(F.col("j")).alias("y")).collect()] == [
        True, False, False, False, False,
    ]


def test_upload_reasons(spark):
    rows = [
        (1, "private", "cv.PDF", 10), (9, "private", "cv.pdf", 10), (1, "group", "cv.pdf", 10), (1, "private", None, 10),
        (1, "private", "a/cv.pdf", 10), (1, "private", "cv.exe", 10), (1, "private", ".pdf", 10), (1, "private", "cv.docx", 101),
        (1, "private", "cv.docx", None), (None, "private", "cv.pdf", 1),
    ]
    df = spark.createDataFrame(rows, "u bigint, c string, f string, s bigint")
    reason = filters.upload_reason(F.col("u"), F.col("c"), F.col("f"), F.col("s"), operators=[1], max_bytes=100)
    assert [r.y for r in df.select(reason.alias("y")).collect()] == [
        None, "unauthorized", "not_private", "no_document", "bad_name", "bad_name", "bad_name", "too_large", None, "unauthorized",
    ]


# ---------------------------------------------------------------- application state
RETRYABLE = set(terms.RETRYABLE_STATUSES)


def fold_clicks(clicks, held):
    """The state machine, one click after the other."""
    state = dict(held)
    out = []
    for update_id, operator, vacancy, outcome in sorted(clicks):
        status = state.get((operator, vacancy))
        if status == "failed":
            row = ("failed", False)
        elif status == "submitting":
            state[operator, vacancy] = "manual_required"
            row = ("manual_required", False)
        elif status is not None and status not in RETRYABLE:
            row = ("skipped", False)
        else:
            state[operator, vacancy] = outcome
            row = (outcome if outcome in ("submitted", "manual_required") else "failed", True)
        out.append((update_id, *row, state[operator, vacancy]))
    return sorted(out)


@pytest.mark.parametrize("seed,run_length", [(1, 3), (2, 10), (3, 1000), (4, 1)])
def test_click_decisions(spark, seed, run_length):
    rng = random.Random(seed)
    outcomes = ["submitted", "loading", "submitting", "failed", "queued", "manual_required", "unsupported_site"]
    clicks = [
        (i, rng.randrange(2), "hot" if rng.random() < 0.4 else f"v{rng.randrange(30)}", rng.choice(outcomes[1:5] + outcomes))
        for i in range(400)
    ]
    held = {(0, "v1"): "submitting", (1, "v2"): "queued", (0, "v3"): "failed", (1, "v4"): "submitted", (1, "hot"): "loading"}
    df = spark.createDataFrame(clicks, "update_id bigint, operator_user_id bigint, vacancy_id string, outcome string")
    current = spark.createDataFrame(
        [(o, v, s) for (o, v), s in held.items()], "operator_user_id bigint, vacancy_fingerprint string, status string"
    )
    columns = ("update_id", "decision", "processed", "status_after")
    assert pairs(applications.decide_clicks(df, current, run_length=run_length), *columns) == fold_clicks(clicks, held)
    assert pairs(applications.decide_clicks(df, run_length=run_length), *columns) == fold_clicks(clicks, {})


def test_worker_outcomes(spark):
    df = spark.createDataFrame(
        [("submitted", None, False, True), ("submitted", None, True, False), ("submitted", None, True, True), ("failed", "x", None, None)],
        "s string, e string, c boolean, b boolean",
    )
    outcome = applications.worker_outcome(F.col("s"), F.col("e"), F.col("c"), F.col("b"))
    assert [tuple(r.y) for r in df.select(outcome.alias("y")).collect()] == [
        ("submitted", None), ("failed", terms.CRASH_BEFORE_ERROR), ("manual_required", terms.CRASH_AFTER_ERROR), ("failed", "x"),
    ]


def test_status_updates(spark):
    apps = spark.createDataFrame([("a", "created", None), ("b", "created", "e")], "application_id string, status string, error_description string")
    changes = spark.createDataFrame(
        [("a", 2, "failed", "why"), ("a", 1, "queued", None), ("z", 9, "queued", None), ("b", 1, "submitted", None)],
        "application_id string, seq int, status string, error string",
    )
    found = applications.update_application_status(apps, changes).na.fill("-")
    assert pairs(found, "application_id", "status", "error_description") == [("a", "failed", "why"), ("b", "submitted", "-")]


# ---------------------------------------------------------------- localization
def test_similarity_equals_difflib(spark):
    rng = random.Random(3)
    texts = [("".join(rng.choice("abc d") for _ in range(n)), "".join(rng.choice("abc d") for _ in range(n + 5))) for n in (0, 1, 9, 50, 300)]
    texts += [("We build APIs!", "we build apis"), ("a", "")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, a string, b string")
    found = [r.y for r in df.select("i", text_similarity(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()]

    def plain(text):
        return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())

    assert found == [SequenceMatcher(None, plain(a), plain(b)).ratio() for a, b in texts]


def test_localization_gate(spark):
    empty, wrong, copied = terms.LOCALIZATION_REASONS
    original = "We build services with Python and разраб"
    posts = spark.createDataFrame(
        [(1, original), (2, "Мы пишем на Python"), (3, original), (4, " "), (5, original)], "k int, description string"
    )
    texts = spark.createDataFrame(
        [
            (1, 1, ""), (1, 2, "still english"), (1, 3, "  Мы пишем сервисы   на Python "), (1, 4, "поздний вариант"),
            (2, 1, "не нужно"), (3, 1, "english only"), (5, 1, original.replace("build", "строим все сервисы и системы тут")),
        ],
        "k int, model_rank int, text string",
    )
    attempts = localization.localization_attempts(posts, texts, "k")
    reasons = {(r.k, r.model_rank): r.reason for r in attempts.collect()}
    assert reasons[1, 1] == empty and reasons[1, 2] == wrong and reasons[1, 3] is None and reasons[3, 1] == wrong
    assert (2, 1) not in reasons
    chosen = {r.k: r.description for r in localization.localize_posts(posts, texts, "k").collect()}
    assert chosen[1] == "Мы пишем сервисы на Python" and chosen[2] == "Мы пишем на Python"
    assert chosen[3] == original and chosen[4] == " "
    strict = {r.k for r in localization.localize_posts(posts, texts, "k", keep_original=False).collect()}
    assert {1, 2, 4} <= strict and 3 not in strict
    same = spark.createDataFrame([("abcd где ", "abcd гдее")], "a string, b string")
    reason = filters.localization_reason(F.col("a"), F.col("b"), min_ratio=0.45)
    assert same.select(reason.alias("y")).collect()[0].y == copied


# ---------------------------------------------------------------- reports
def test_reports(spark):
    now = datetime(2026, 7, 20, tzinfo=UTC)
    fresh, stale = now - timedelta(hours=1), now - timedelta(days=40)
    found = spark.createDataFrame(
        [
            ("p", "u1", "f1", 1, None), ("p", "u1", "f2", 2, fresh), ("q", "u1", "f1", 3, stale), ("q", "u2", "f1", 4, stale),
            ("q", "u3", "f2", 5, None), ("p", "", "f9", 6, fresh),
        ],
        "provider string, url string, family string, position int, published_at timestamp",
    )
    log = spark.createDataFrame(
        [("p", 1, True, None), ("p", 2, False, "E2"), ("p", 3, False, "E3"), ("q", 1, True, None), ("r", 1, False, "X")],
        "provider string, ord int, ok boolean, error_type string",
    )
    report = aggregates.provider_report(found, log)
    assert pairs(report.na.fill("-"), "provider", "candidate_count", "queries_attempted", "query_errors", "error_type", "status") == [
        ("p", 1, 3, 2, "E2", "degraded"), ("q", 3, 1, 0, "-", "ok"), ("r", 0, 1, 1, "X", "error"),
    ]
    real = found.filter("url <> ''")
    assert pairs(aggregates.family_counts(real), "provider", "family", "urls") == [("p", "f1", 1), ("q", "f1", 2), ("q", "f2", 1)]
    total = aggregates.discovery_report(real, log, now=now, max_age_hours=24).collect()[0]
    assert tuple(total) == ("degraded", 3, 4, 3, 1, 1, 1)

    def status(candidates, queries):
        return aggregates.discovery_report(candidates, queries, now=now, max_age_hours=24).collect()[0].status

    assert status(real, log.filter("false")) == "misconfigured"
    assert status(real, log.filter("provider = 'r'")) == "provider_error"
    assert status(real.filter("false"), log.filter("provider = 'q'")) == "no_results"
    assert status(real, log.filter("provider = 'q'")) == "ok"


# ---------------------------------------------------------------- sources
def test_payload_scan(spark):
    rows = spark.createDataFrame(
        [
            ('{"organic": [7, "x", null, {"title": "Dev - LinkedIn", "link": "https://linkedin.com/posts/a", "date": null}, '
             '{"link": "https://evil.com/posts/a"}]}',),
            ('{"organic_results": {"a": 1}}',), ("not json",), ("{}",), (None,),
        ],
        "payload string",
    )
    found = [tuple(r) for r in scan_search_results(rows).collect()]
    assert found == [("https://www.linkedin.com/posts/a", "Dev", "", "", 4)]


def test_feed_scan(spark):
    feed = (
        "<?xml version='1.0'?><rss><channel><title>x</title><item><title>Backend Developer - LinkedIn</title>"
        "<link>https://www.linkedin.com/posts/a</link><description><![CDATA[<b>We</b> hire &amp; pay]]></description>"
        "<pubDate>Fri, 17 Jul 2026 10:00:00 GMT</pubDate></item></channel></rss>"
    )
    rows = spark.createDataFrame([(1, feed), (2, feed[:-20]), (3, "  "), (4, None), (5, "<rss></rss>")], "k int, rss string")
    assert [tuple(r) for r in scan_rss_items(rows).collect()] == [
        (1, 1, "Backend Developer", "https://www.linkedin.com/posts/a", "We hire & pay", "Fri, 17 Jul 2026 10:00:00 GMT")
    ]


PAGE = """<html><body><div class="result big"><a class="result__a" href="/l/?uddg=https%3A%2F%2Fa.b%2F1">One <b>post</b> | LinkedIn</a>
<span class="result__snippet">First <i>snippet</i></span><span class="date-box">Jul 5, 2026</span></div>
<div class="result"><a class="result__a" href="https://a.b/1">again</a></div>
<ul><li class="b_algo"><h2><a href="https://a.b/2">Two</a></h2><div class="b_caption"><p>Second</p></div><time datetime="2026-07-05">x</time></li></ul>
<a href="https://a.b/3">other</a></body></html>"""


def test_result_pages(spark):
    rows = spark.createDataFrame(
        [(1, PAGE), (2, "<a href='x'>X</a><a href='x'>Y</a><a>Z</a>"), (3, PAGE + "captcha"), (4, None), (5, "")],
        "page_id bigint, html string",
    )
    found = pairs(scan_result_pages(rows), "page_id", "position", "title", "link", "snippet", "date_text")
    assert found == [
        (1, 1, "One post", "/l/?uddg=https%3A%2F%2Fa.b%2F1", "First snippet", "Jul 5, 2026"),
        (1, 3, "Two", "https://a.b/2", "Second", "2026-07-05"),
        (2, 1, "X", "x", "", ""),
    ]


def test_main_text_of_nested_elements(spark):
    page = (
        "<div class='feed-shared-inline-show-more-text'>later</div>"
        "<div class='feed-shared-update-v2__description-wrapper x'>a<div>b</div><script>c</script>d &amp; e</div>"
    )
    other = "<article><p class='attributed-text-segment-list__content'> </p><span class='my-attributed-text-segment-list__content'>s</span></article>"
    rows = spark.createDataFrame([(1, page), (2, other), (3, "<p>x</p>"), (4, None)], "k int, html string")
    assert pairs(rows.select("k", page_main_text(F.col("html")).alias("t")), "k", "t") == [
        (1, "a b d & e"), (2, "s"), (3, ""), (4, ""),
    ]


def test_main_texts_of_a_batch_are_not_held_together():
    pages = [None if n % 7 == 0 else f"<article>{n} {'ä' * 5000}</article>" for n in range(2000)]
    batches = [pa.array(pages, pa.string()), pa.array([], pa.string()), pa.array(pages[:3], pa.string())]
    wanted = [None if n % 7 == 0 else f"{n} {'ä' * 5000}"[:4000] for n in (*range(2000), 0, 1, 2)]
    list(first_texts(iter(batches[2:]), ["article"], 4000))  # what a first call keeps for good
    tracemalloc.start()
    place = 0
    for texts in first_texts(iter(batches), ["p.none", "article"], 4000):
        assert texts.type == pa.string() and len(texts) <= PAGES_AT_ONCE
        assert texts.to_pylist() == wanted[place : place + len(texts)]
        place += len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert place == len(wanted)
    assert peak < 5_000_000  # the batch as strings takes 10 MB for pages and 8 MB for texts


def test_main_texts_keep_to_their_pages_across_batches(spark):
    rows = spark.range(0, 25_000, numPartitions=2).withColumn(
        "html", F.when(F.col("id") % 3 != 0, F.concat(F.lit("<article>page <b>"), "id", F.lit("</b></article>")))
    )
    text = rows.select("id", "html", page_main_text(F.col("html"), ("article",)).alias("t"))
    wanted = F.when(F.col("html").isNull(), "").otherwise(F.concat(F.lit("page "), F.col("id").cast("string")))
    assert text.count() == 25_000 and text.filter(~F.col("t").eqNullSafe(wanted)).isEmpty()


def test_page_posts(spark):
    wall = "<input type='password'>"
    body = "<p class='attributed-text-segment-list__content'>We hire. Join   us</p>"
    address = "https://de.linkedin.com/posts/a-activity-7483822807449600000-x"
    rows = spark.createDataFrame(
        [
            (1, address + "?trk=1", f"<title>Senior Go\nDeveloper | X</title>{body}{wall}"),
            (2, address, wall), (3, address, body + "complete the CAPTCHA"), (4, "https://de.linkedin.com/posts/b", body),
            (5, "https://evil.org/posts/a-activity-7483822807449600000", body), (6, address, None),
        ],
        "page_id int, url string, html string",
    )
    found = jobs.page_posts(rows, "Pages").collect()
    assert [(r.page_id, r.url, r.title, r.description) for r in found] == [
        (1, address.replace("de.", "www."), "Senior Go Developer", "We hire. Join us")
    ]


def test_result_page_posts(spark):
    page = PAGE.replace("https%3A%2F%2Fa.b%2F1", "https%3A%2F%2Fwww.linkedin.com%2Fposts%2Fa")
    rows = spark.createDataFrame([(1, page), (2, page)], "page_id bigint, html string")
    found = jobs.result_page_posts(rows, "Search").collect()
    assert [(r.page_id, r.url, r.title, r.description) for r in found] == [
        (1, "https://www.linkedin.com/posts/a", "One post", "First snippet")
    ]


def test_messages_and_registry(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    (folder / "b.txt").write_text("три", encoding="utf-8")
    assert sorted(r.text for r in scan_messages(spark, str(folder)).collect()) == ["one\ntwo\n", "три"]
    registry = SourceRegistry()
    registry.register("gone", lambda s, p: s.read.parquet(p))
    registry.register("files", lambda s, p: scan_messages(s, p).select("text"))
    rows = registry.read(spark, {"gone": str(tmp_path / "nothing"), "files": str(folder)})
    assert {(r.source, r.source_rank) for r in rows.collect()} == {("files", 1)}
    with pytest.raises(ValueError):
        registry.read(spark, {"gone": str(tmp_path / "nothing")})


# ---------------------------------------------------------------- blanks, ties and repeated keys
def test_reports_trim_and_skip_blank_urls(spark):
    rows = [("p", u, f, 1, None) for u, f in (("", "a"), (" ", "a"), ("u", "b"), (" u ", "a"), (None, "a"))]
    df = spark.createDataFrame(rows, "provider string, url string, family string, position int, published_at timestamp")
    log = spark.createDataFrame([("p", 1, True, None)], "provider string, ord int, ok boolean, error_type string")
    now = datetime(2026, 7, 20, tzinfo=UTC)
    assert pairs(aggregates.family_counts(df), "provider", "family", "urls") == [("p", "a", 1)]
    report = aggregates.discovery_report(df, log, now=now, max_age_hours=24).collect()[0]
    assert (report.candidate_count, report.unique_count, report.undated) == (1, 1, 1)


def test_provenance_does_not_depend_on_the_input_order(spark):
    rows = [("u", p, f"q{i}", 1) for i, p in enumerate(("b", "a", "c"))]
    schema = "url string, provider string, query string, position int"
    found = {
        tuple(dedupe.distinct_urls(spark.createDataFrame(r, schema), [F.col("position")]).collect()[0])
        for r in (rows, rows[::-1])
    }
    assert found == {("u", "a", "q1", 1)}


def test_one_shot_tells_posts_of_one_position_apart(spark):
    posts = spark.createDataFrame([(0, 1, "old"), (0, 1, "new")], "source_rank int, position int, fingerprint string")
    ledger = spark.createDataFrame([("old",)], "fingerprint string")
    assert pairs(discovery.cap_then_dedupe(posts, ledger, 5), "fingerprint") == [("new",)]


def test_localization_keeps_posts_of_one_key_apart(spark):
    posts = spark.createDataFrame([(1, "first text here"), (1, "second text here")], "k int, description string")
    texts = spark.createDataFrame([], "k int, model_rank int, text string")
    assert localization.localize_posts(posts, texts, "k").count() == 2
