"""Filter, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill import terms
from hiremill.catalog.base import (
    lit,
    CUTOFF_SQL,
    MAX_AGE_HOURS,
    NOW,
    conversations,
    documents,
    ledger,
    posts,
    query,
    sql_any,
    table,
    updates,
    web_pages,
    with_views,
)
from hiremill.functions import html, urls
from hiremill.functions.extract import error_reason
from hiremill.functions.identity import valid_fingerprint
from hiremill.operators import applications, filters, joins, localization, sets
from hiremill.operators.dedupe import drop_seen, with_fingerprint
from hiremill.session import work_folder
from hiremill.sources.files import read_files
from hiremill.sources.landed import register as register_landed
from hiremill.sources.registry import SourceRegistry

_TEXT = "concat_ws(' ', title, description)"
ROLE_SQL = f"({sql_any(_TEXT, terms.ALLOWED_ROLE_TERMS)} AND NOT {sql_any(_TEXT, terms.DENIED_ROLE_TERMS)})"
FRESH_SQL = f"coalesce(published_at >= {CUTOFF_SQL}, true)"
ACCENTED = {"script": "À-ÿ", "letters": "A-Za-zÀ-ÿ", "min_ratio": 0.05}


# ---------------------------------------------------------------- filters
@query("filter_role_policy", with_views(["posts"], f"SELECT k, title FROM posts WHERE {ROLE_SQL}"))
def filter_role_policy(spark, folder):
    return filters.filter_role_policy(posts(spark, folder)).select("k", "title")


_TOKENS = r"(^|[^\w])(go|react|python)([^\w]|$)"


@query(
    "filter_role_policy_tokens",
    with_views(["posts"], f"SELECT k, title FROM posts WHERE regexp_matches(lower({_TEXT}), '{_TOKENS}')"),
)
def filter_role_policy_tokens(spark, folder):
    kept = filters.filter_role_policy(posts(spark, folder), ["go", "react", "python"], [], mode="token")
    return kept.select("k", "title")


@query(
    "filter_it_broad",
    with_views(
        ["posts"],
        f"SELECT k, title FROM posts WHERE {sql_any(_TEXT, terms.BROAD_IT_TERMS)} "
        f"AND NOT {sql_any(_TEXT, terms.DENIED_ROLE_TERMS)}",
    ),
)
def filter_it_broad(spark, folder):
    return filters.filter_it_broad(posts(spark, folder)).select("k", "title")


@query(
    "filter_intake",
    with_views(
        ["posts"],
        "SELECT id, text FROM (SELECT concat('p', CAST(k AS VARCHAR)) AS id, raw_text AS text FROM posts UNION ALL "
        "SELECT concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)), text FROM conversations) "
        r"WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 24 "
        f"AND {sql_any('text', terms.ALLOWED_ROLE_TERMS)} AND NOT {sql_any('text', terms.DENIED_ROLE_TERMS)}",
    ),
)
def filter_intake(spark, folder):
    from_posts = posts(spark, folder).selectExpr("concat('p', k) AS id", "raw_text AS text")
    from_chats = conversations(spark, folder).selectExpr("concat('c', conv_id, '-', turn) AS id", "text")
    return filters.filter_intake(from_posts.unionByName(from_chats))


@query(
    "filter_fresh",
    with_views(["posts"], f"SELECT k, published_at IS NULL AS undated FROM posts WHERE {FRESH_SQL}"),
)
def filter_fresh(spark, folder):
    kept = filters.filter_fresh(posts(spark, folder), now=NOW, max_age_hours=MAX_AGE_HOURS)
    return kept.select("k", F.col("published_at").isNull().alias("undated"))


@query(
    "filter_fresh_dated",
    with_views(["posts"], f"SELECT k FROM posts WHERE published_at >= {CUTOFF_SQL}"),
)
def filter_fresh_dated(spark, folder):
    rows = posts(spark, folder)
    return filters.filter_fresh(rows, now=NOW, max_age_hours=MAX_AGE_HOURS, require_published_at=True).select("k")


_CHALLENGE = ("track(0)", "captcha", "spam-farm")


@query("is_challenge_page", f"SELECT page_id, {sql_any('html', _CHALLENGE)} AS challenge FROM pages")
def is_challenge_page(spark, folder):
    return web_pages(spark, folder).select(
        "page_id", html.is_challenge_page(F.col("html"), _CHALLENGE).alias("challenge")
    )


_DOMAINS = ("example.com", "ththan.example.net")
_HOST = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"


@query(
    "domain_allowed",
    f"SELECT page_id, {' OR '.join(f'{_HOST} = {d!r} OR ends_with({_HOST}, {chr(39)}.{d}{chr(39)})' for d in _DOMAINS)} "
    "AS allowed FROM pages",
)
def domain_allowed(spark, folder):
    return web_pages(spark, folder).select("page_id", urls.domain_allowed(F.col("url"), _DOMAINS).alias("allowed"))


_SUCCESS = ("spam", "the and", "le des")


@query(
    "verified_success",
    f"SELECT page_id, NOT contains(url, '?') AND {sql_any('html', _SUCCESS)} AS verified FROM pages",
)
def verified_success(spark, folder):
    form = F.contains("url", F.lit("?"))
    return web_pages(spark, folder).select(
        "page_id", html.verified_success(F.col("html"), form, _SUCCESS).alias("verified")
    )


_ACCENTS = "length(regexp_replace({0}, '[^À-ÿ]', '', 'g'))"
_LETTERS = "length(regexp_replace({0}, '[^A-Za-zÀ-ÿ]', '', 'g'))"
BELOW_SQL = f"({_LETTERS} > 0 AND {_ACCENTS} / {_LETTERS} < 0.05)"


@query(
    "needs_localization",
    f"SELECT doc_id, trim(text) <> '' AND {BELOW_SQL.format('text')} AS needed FROM documents",
)
def needs_localization(spark, folder):
    needed = filters.needs_localization(F.col("text"), **ACCENTED)
    return documents(spark, folder).select("doc_id", needed.alias("needed"))


def localized_texts(spark, folder):
    """Offered texts by model: an empty or unaccented one, and one in the target script."""
    rows = documents(spark, folder)
    plain = F.regexp_replace("text", "[À-ÿ]+", "")
    offers = F.array(
        F.struct(F.lit(1).alias("model_rank"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(plain).alias("text")),
        F.struct(F.lit(2).alias("model_rank"), F.concat(F.lit("Éà ô "), "source", F.lit(" ïé ùà")).alias("text")),
    )
    return rows.select("doc_id", F.explode(offers).alias("o")).select("doc_id", "o.model_rank", "o.text")


def _documents(spark, folder):
    return documents(spark, folder).withColumnRenamed("text", "description").select("doc_id", "description")


# texts short enough that the similarity of two of the same letters is exactly one
_SHORT = "substr(text, 1, 150)"


def _short_offers(spark, folder):
    """Four offers for the beginning of every document: none, one in the wrong script, the original in accents, a new one."""
    start = F.left(F.col("text"), F.lit(150))
    offers = [
        F.lit(" "), F.regexp_replace(start, "[À-ÿ]+", ""),
        F.concat(F.repeat(F.lit("é "), F.length(start)), start), F.lit("Éà ô ïé"),
    ]
    rows = documents(spark, folder).select("doc_id", start.alias("description"), F.array(*offers).alias("offers"))
    texts = rows.select("doc_id", F.posexplode("offers").alias("model_rank", "text"))
    return rows.drop("offers"), texts


@query(
    "validate_localized",
    f"SELECT doc_id, unnest([0, 1, 2, 3]) AS model_rank, unnest([{', '.join(lit(r) for r in terms.LOCALIZATION_REASONS)}, NULL]) "
    f"AS reason FROM (SELECT doc_id, {_SHORT} AS text FROM documents) WHERE trim(text) <> '' AND {BELOW_SQL.format('text')}",
)
def validate_localized(spark, folder):
    """Offers whose outcome is known: refused as empty, for their script, as a copy, and accepted."""
    posts, texts = _short_offers(spark, folder)
    attempts = localization.localization_attempts(posts, texts, "doc_id", **ACCENTED)
    return attempts.select("doc_id", "model_rank", "reason")


@query(
    "localization_errors",
    f"SELECT doc_id, 1 AS model_rank, CASE WHEN doc_id % 2 = 0 THEN '{terms.LOCALIZATION_REASONS[0]}' "
    f"ELSE '{terms.LOCALIZATION_REASONS[1]}' END AS reason FROM documents "
    f"WHERE trim(text) <> '' AND {BELOW_SQL.format('text')}",
)
def localization_errors(spark, folder):
    attempts = localization.localization_attempts(
        _documents(spark, folder), localized_texts(spark, folder), "doc_id", **ACCENTED
    )
    return localization.localization_errors(attempts, "doc_id")


OFFER_2_SQL = "concat('Éà ô ', source, ' ïé ùà')"


# the first offer is empty or in the wrong script, so only the second can be accepted
@query(
    "localization_gate",
    f"SELECT doc_id, CASE WHEN trim(text) <> '' AND {BELOW_SQL.format('text')} THEN {OFFER_2_SQL} ELSE text END "
    "AS description FROM documents",
)
def localization_gate(spark, folder):
    texts = localized_texts(spark, folder)
    return localization.localize_posts(_documents(spark, folder), texts, "doc_id", **ACCENTED)


@query(
    "localization_gate_strict",
    "SELECT doc_id, description FROM (SELECT doc_id, text AS description, "
    f"trim(text) <> '' AND {BELOW_SQL.format('text')} AS needed FROM documents) WHERE NOT needed",
)
def localization_gate_strict(spark, folder):
    texts = localized_texts(spark, folder).filter("model_rank = 1")
    return localization.localize_posts(
        _documents(spark, folder), texts, "doc_id", keep_original=False, **ACCENTED
    )


@query(
    "validate_upload",
    with_views(["updates"], "SELECT update_id, coalesce(upload_reason, 'accepted') AS reason FROM updates"),
)
def validate_upload(spark, folder):
    return updates(spark, folder).select("update_id", F.coalesce("upload_reason", F.lit("accepted")).alias("reason"))


@query(
    "valid_fingerprint",
    with_views(["updates"], "SELECT update_id, coalesce(regexp_full_match(vacancy_id, '[0-9a-f]{32}'), false) AS valid FROM updates"),
)
def valid_fingerprints(spark, folder):
    return updates(spark, folder).select("update_id", valid_fingerprint(F.col("vacancy_id")).alias("valid"))


_PROFILE = (
    "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE replace(c_name, '#', ' ') END AS full_name",
    "CASE WHEN c_acctbal > 2000 THEN concat(lower(c_mktsegment), '@example.com') ELSE '' END AS email",
    "CASE WHEN c_nationkey > 5 THEN 'cv.pdf' END AS resume",
)


@query(
    "profile_gaps",
    f"""SELECT c_custkey, array_to_string(gaps, '; ') AS gaps FROM (SELECT c_custkey, list_filter([
  CASE WHEN NOT contains(trim(full_name), ' ') THEN 'имя и фамилия' END, CASE WHEN email = '' THEN 'email' END,
  CASE WHEN resume IS NULL THEN 'резюме в PDF или DOCX' END], lambda x: x IS NOT NULL) AS gaps
  FROM (SELECT c_custkey, {', '.join(_PROFILE)} FROM customer)) WHERE len(gaps) > 0""",
)
def profile_gaps(spark, folder):
    rows = table(spark, folder, "customer").selectExpr("c_custkey", *_PROFILE)
    gaps = filters.profile_gaps(F.col("full_name"), F.col("email"), F.col("resume"))
    found = rows.select("c_custkey", gaps.alias("gaps")).filter(F.size("gaps") > 0)
    return found.withColumn("gaps", F.array_join("gaps", "; "))


_ERRORS = (
    "CASE event_id % 6 WHEN 0 THEN ' Login  is required. ' WHEN 1 THEN 'Site protection detected.' WHEN 2 THEN NULL "
    "WHEN 3 THEN 'Browser inspection failed: TimeoutError' WHEN 4 THEN 'something else' ELSE '' END AS error"
)
_REASONS = dict(terms.ERROR_REASONS)


@query(
    "explain_error",
    "SELECT event_id, CASE event_id % 6 "
    f"WHEN 0 THEN '{_REASONS['login is required']}' WHEN 1 THEN '{_REASONS['site protection detected']}' "
    f"WHEN 3 THEN '{_REASONS['browser inspection failed']}' WHEN 4 THEN '{terms.DEFAULT_ERROR_REASON}' END AS reason "
    "FROM events",
)
def explain_error(spark, folder):
    rows = table(spark, folder, "events").selectExpr("event_id", _ERRORS)
    return rows.select("event_id", error_reason(F.col("error")).alias("reason"))


# ---------------------------------------------------------------- joins
@query(
    "drop_seen",
    with_views(
        ["prints", "ledger"],
        "SELECT k, fingerprint FROM prints WHERE fingerprint NOT IN (SELECT fingerprint FROM ledger)",
    ),
)
def drop_seen_posts(spark, folder):
    return drop_seen(with_fingerprint(posts(spark, folder)), ledger(spark, folder)).select("k", "fingerprint")


@query(
    "authorized_only",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)",
)
def authorized_only(spark, folder):
    allowed = table(spark, folder, "customer").filter("c_acctbal > 1000").select("c_custkey")
    return joins.authorized_only(table(spark, folder, "events"), allowed).select("event_id", "user_id")


@query("authorized_by_default", "SELECT count(*) AS everyone, 0 AS nobody FROM events")
def authorized_by_default(spark, folder):
    events = table(spark, folder, "events")
    everyone = joins.authorized_only(events, []).select(F.lit(1).alias("e"), F.lit(0).alias("n"))
    nobody = joins.authorized_only(events, [], when_empty="nobody").select(F.lit(0).alias("e"), F.lit(1).alias("n"))
    both = everyone.unionByName(nobody)
    return both.agg(F.sum("e").alias("everyone"), F.sum("n").cast("int").alias("nobody"))


@query(
    "request_to_post",
    with_views(
        ["updates", "ledger"],
        "SELECT update_id, vacancy_id, url AS vacancy_url, title AS vacancy_title FROM updates "
        "JOIN ledger ON vacancy_id = fingerprint WHERE kind = 'apply'",
    ),
)
def request_to_post(spark, folder):
    asked = updates(spark, folder).filter("kind = 'apply'")
    return joins.request_to_post(asked, ledger(spark, folder)).select(
        "update_id", "vacancy_id", "vacancy_url", "vacancy_title"
    )


@query(
    "term_match",
    with_views(
        ["posts"],
        "SELECT k, term FROM posts JOIN (SELECT n_name AS term FROM nation UNION SELECT n_name[1:1] FROM nation "
        "UNION SELECT c_mktsegment FROM customer UNION SELECT substr(raw_text, 1, 5 + k % 196) FROM posts "
        "WHERE k % 500 = 1) ON contains(lower(raw_text), lower(term))",
    ),
)
def term_match(spark, folder):
    nations = table(spark, folder, "nation")
    dictionary = (
        nations.selectExpr("n_name AS term")
        .unionByName(nations.selectExpr("left(n_name, 1) AS term"))
        .unionByName(table(spark, folder, "customer").selectExpr("c_mktsegment AS term"))
    )
    rows = posts(spark, folder)
    long_terms = rows.filter("k % 500 = 1").selectExpr("left(raw_text, CAST(5 + k % 196 AS INT)) AS term")
    return joins.term_match(rows, dictionary.unionByName(long_terms), key="k", text="raw_text")


_STORED = (
    "user_id AS operator_user_id",
    "CASE WHEN event_type = 'view' THEN 'cv-new.pdf' WHEN event_type = 'error' THEN 'lost.pdf' END AS resume_original_name",
    "CASE WHEN event_type = 'view' THEN concat('f', event_id) END AS resume_file_id",
)


@query(
    "profile_with_defaults",
    f"""SELECT c_custkey AS operator_user_id, c_name AS full_name, concat(lower(c_name), '@x.y') AS email,
  CASE WHEN c_nationkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS phone,
  concat_ws(';', CASE WHEN c_nationkey % 2 = 0 THEN 'cover_letter=hello' END, concat('personal_url=https://', c_mktsegment))
    AS extra,
  CASE WHEN s.file IS NOT NULL THEN s.name ELSE 'default.pdf' END AS resume_original_name,
  coalesce(s.file, CASE WHEN c_nationkey > 10 THEN 'f-default' END) AS resume_file_id
FROM customer LEFT JOIN (SELECT user_id, 
  max_by(struct_pack(f := resume_file_id, n := resume_original_name), event_id).f AS file,
  max_by(struct_pack(f := resume_file_id, n := resume_original_name), event_id).n AS name
  FROM (SELECT event_id, user_id, {', '.join(_STORED[1:])} FROM events) GROUP BY user_id) s ON c_custkey = s.user_id""",
)
def profile_with_defaults(spark, folder):
    configured = table(spark, folder, "customer").selectExpr(
        "c_custkey AS operator_user_id", "concat('  ', c_name, chr(10)) AS full_name",
        "concat(lower(c_name), '@x.y ') AS email",
        "CASE c_nationkey % 3 WHEN 0 THEN ' ' ELSE concat(' ', c_nationkey) END AS phone",
        "concat('https://', c_mktsegment, ' ') AS personal_url",
        "CASE WHEN c_nationkey % 2 = 0 THEN ' hello' ELSE ' ' END AS cover_letter", "'default.pdf' AS resume_original_name",
        "CASE WHEN c_nationkey > 10 THEN ' f-default ' ELSE ' ' END AS resume_file_id",
    )
    log = table(spark, folder, "events").selectExpr("event_id", *_STORED)
    stored = log.groupBy("operator_user_id").agg(
        F.max_by(F.struct("resume_original_name", "resume_file_id"), "event_id").alias("r")
    )
    found = joins.profile_with_defaults(configured, stored.select("operator_user_id", "r.*"))
    pairs = F.transform(F.array_sort(F.map_entries("extra_fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.withColumn("extra", F.array_join(pairs, ";")).drop("extra_fields")


_OUTCOME = (
    "event_id AS application_id", "event_id % 4 = 0 AS crashed", "event_id % 8 = 0 AS submit_started",
    "CASE WHEN value > 10 THEN 'submitted' ELSE 'unsupported_site' END AS status",
    "CASE WHEN value > 10 THEN NULL ELSE 'no adapter' END AS error",
)


@query(
    "outcome_to_application",
    f"""SELECT k AS application_id,
  CASE WHEN application_id IS NULL THEN 'loading' WHEN submit_started THEN 'manual_required' WHEN crashed THEN 'failed'
    ELSE status END AS status,
  CASE WHEN application_id IS NULL THEN NULL WHEN submit_started THEN '{terms.CRASH_AFTER_ERROR}'
    WHEN crashed THEN '{terms.CRASH_BEFORE_ERROR}' ELSE error END AS error_description
FROM (SELECT o_orderkey AS k FROM orders) LEFT JOIN (SELECT {', '.join(_OUTCOME)} FROM events) ON k = application_id""",
)
def outcome_to_application(spark, folder):
    begun = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS application_id", "'loading' AS status", "CAST(NULL AS STRING) AS error_description"
    )
    ran = table(spark, folder, "events").selectExpr(*_OUTCOME)
    left = applications.worker_outcome(F.col("status"), F.col("error"), F.col("crashed"), F.col("submit_started"))
    outcomes = ran.select("application_id", left.alias("o")).select("application_id", "o.status", "o.error")
    return joins.outcome_to_application(begun, outcomes)


# ---------------------------------------------------------------- sets
SOURCES = ("MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE")
_RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCES)) + " END"


@query(
    "union_sources",
    with_views(
        ["posts"],
        f"SELECT k, source, CAST({_RANK} AS INTEGER) AS source_rank, "
        "CASE WHEN source = 'MACHINERY' THEN NULL ELSE url END AS url FROM posts WHERE source <> 'BUILDING'",
    ),
)
def union_sources(spark, folder):
    """The first source has no URL column and the fourth could not be read."""

    def read(name):
        rows = posts(spark, folder).filter(F.col("source") == name)
        if name == "BUILDING":
            return None
        return rows.select("k") if name == SOURCES[0] else rows.select("k", "url")

    return sets.union_sources([(name, read(name)) for name in SOURCES])


@query(
    "source_registry",
    with_views(
        ["posts"],
        "SELECT k, source, CASE source WHEN 'orders' THEN 0 ELSE 2 END AS source_rank FROM "
        "(SELECT k, 'orders' AS source FROM posts UNION ALL SELECT event_id, 'events' FROM events)",
    ),
)
def source_registry(spark, folder):
    """Three registered sources, one of them missing."""
    registry = SourceRegistry()
    registry.register("orders", lambda s, path: s.read.parquet(path).selectExpr("o_orderkey AS k"))
    registry.register("missing", lambda s, path: s.read.parquet(path))
    registry.register("events", lambda s, path: s.read.parquet(path).selectExpr("event_id AS k"))
    return registry.read(spark, {name: f"{folder}/{name}.parquet" for name in registry.names})


@query(
    "only_new",
    with_views(["prints", "ledger"], "SELECT fingerprint FROM prints EXCEPT SELECT fingerprint FROM ledger"),
)
def only_new(spark, folder):
    return sets.only_new(with_fingerprint(posts(spark, folder)), ledger(spark, folder))


@query(
    "isolated_sources",
    "SELECT o_orderkey AS k, 0 AS source_rank, 'orders' AS source, NULL AS error FROM orders UNION ALL "
    "SELECT event_id, 3, 'events', NULL FROM events UNION ALL "
    "SELECT NULL, NULL, name, kind FROM (VALUES ('missing', 'AnalysisException'), ('broken', 'failed')) AS e(name, kind)",
)
def isolated_sources(spark, folder):
    """A source that is not there and one that fails while it is read cost their own rows."""
    registry = SourceRegistry()
    registry.register("orders", lambda s, path: s.read.parquet(path).selectExpr("o_orderkey AS k"))
    registry.register("missing", lambda s, path: s.read.parquet(path))
    fail = "CASE WHEN o_orderkey > 0 THEN raise_error('broken') END"
    registry.register("broken", lambda s, path: s.read.parquet(path).selectExpr(f"CAST({fail} AS BIGINT) AS k"))
    registry.register("events", lambda s, path: s.read.parquet(path).selectExpr("event_id AS k"))
    paths = {name: f"{folder}/{name}.parquet" for name in registry.names} | {"broken": f"{folder}/orders.parquet"}
    rows, errors = registry.collect(spark, paths, "k bigint")
    told = errors.select(
        F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("int").alias("source_rank"), "source",
        # the class of an error inside a task differs between Spark's releases
        F.when(F.col("source") == "missing", F.col("error")).otherwise("failed").alias("error"),
    )
    return rows.select("k", "source_rank", "source", F.lit(None).cast("string").alias("error")).unionByName(told)


FILES = 10
_BROKEN_FILE = 7


@query(
    "isolated_files",
    f"SELECT o_orderkey AS k, CAST(o_orderkey % {FILES} AS INTEGER) AS folder, false AS broken FROM orders "
    f"WHERE o_orderkey % {FILES} <> {_BROKEN_FILE} UNION ALL SELECT NULL, {_BROKEN_FILE}, true",
)
def isolated_files(spark, folder):
    """The orders in ten files, one of which is none: it costs its rows and is told."""
    target = work_folder(spark, "isolated")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    for number in range(FILES):
        own = rows.where(F.pmod("k", F.lit(FILES)) == number).coalesce(1)
        if number == _BROKEN_FILE:
            own.select(F.col("k").cast("string")).write.text(f"{target}/part={number}")
        else:
            own.write.parquet(f"{target}/part={number}")
    found, errors = read_files(spark, target, "k bigint")
    number = F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("folder")
    told = errors.select(F.lit(None).cast("bigint").alias("k"), number, F.lit(True).alias("broken"))
    return found.select("k", number, F.lit(False).alias("broken")).unionByName(told)


LANDINGS = 3


def _land(spark, folder, target, number):
    """A third of the conversations as two files of JSON lines, under names that ascend with the number."""
    rows = table(spark, folder, "conversations")
    own = rows.where(F.pmod("conv_id", F.lit(LANDINGS)) == number).select(F.to_json(F.struct(*rows.columns)).alias("value"))
    own.repartition(2).write.text(f"{target}/{number:03d}")


def _messages(payloads):
    fields = "conv_id bigint, turn bigint, role string, text string"
    return payloads.select(F.from_json("payload", fields).alias("m")).select("m.*")


_CONVERSATIONS = "SELECT conv_id, turn, role, text FROM conversations"


@query("read_landed", _CONVERSATIONS)
def read_landed(spark, folder):
    """Landed payloads through the library's own data source."""
    target = work_folder(spark, "landed")
    for number in range(LANDINGS):
        _land(spark, folder, target, number)
    register_landed(spark)
    return _messages(spark.read.format("landed").load(target))


@query("stream_landed", _CONVERSATIONS)
def stream_landed(spark, folder):
    """The same as a stream: each of three runs goes on behind the last file of the one before."""
    target, out = work_folder(spark, "landed"), work_folder(spark, "landed-rows")
    register_landed(spark)
    for number in range(LANDINGS):
        _land(spark, folder, target, number)
        rows = _messages(spark.readStream.format("landed").load(target))
        run = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")
