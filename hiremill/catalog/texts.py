"""Text, date and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill import terms
from hiremill.catalog.base import (
    NOW,
    candidates,
    conversations,
    documents,
    epoch,
    lit,
    posts,
    query,
    sql_any,
    sql_list,
    sql_unique,
    table,
    with_views,
)
from hiremill.functions import cards, dates, extract, text, urls
from hiremill.functions.identity import identity_source, post_fingerprint
from hiremill.plans import jobs
from hiremill.sources.payloads import candidates_to_posts, scraped_to_posts

_HITS = (
    f"list_filter({sql_list(terms.TECH_KEYWORDS)}, lambda w: contains({{0}}, lower(w)) "
    "AND NOT (w = 'SQL' AND (contains({0}, 'postgresql') OR contains({0}, 'mysql'))))"
)


@query(
    "extract_urls",
    with_views(
        ["posts"],
        r"""SELECT k, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS urls
FROM (SELECT k, list_transform(regexp_extract_all(concat(raw_text, ' ', coalesce(url, ''), ';'),
  '(?i)https?://[^\s<>)"'']+'), lambda u: rtrim(u, '.,;')) AS l FROM posts)""",
    ),
)
def extract_urls(spark, folder):
    message = F.concat("raw_text", F.lit(" "), F.coalesce("url", F.lit("")), F.lit(";"))
    return posts(spark, folder).select("k", F.array_join(urls.extract_urls(message), " ").alias("urls"))


@query(
    "extract_stack",
    with_views(
        ["posts"],
        f"SELECT k, array_to_string({_HITS.format('lower(raw_text)')}, ',') AS stack FROM posts",
    ),
)
def extract_stack(spark, folder):
    return posts(spark, folder).select("k", F.array_join(extract.extract_stack(F.col("raw_text")), ",").alias("stack"))


_SENTENCES = (
    "SELECT k, list_filter(flatten(list_transform(list_filter(regexp_split_to_array(lower(raw_text), '[\\n.!?]+'), "
    f"lambda s: list_bool_or(list_transform({sql_list(terms.STACK_EVIDENCE_TERMS)}, lambda t: contains(s, t)))), "
    f"lambda s: {_HITS.format('s')})), lambda w: NOT list_contains({sql_list(terms.VAGUE_KEYWORDS)}, w)) AS l "
    "FROM posts"
)


@query(
    "extract_stack_with_evidence",
    with_views(
        ["posts"], f"SELECT k, array_to_string({sql_unique('l')}, ',') AS stack FROM ({_SENTENCES})"
    ),
)
def extract_stack_with_evidence(spark, folder):
    stack = extract.extract_stack_with_evidence(F.col("raw_text"))
    return posts(spark, folder).select("k", F.array_join(stack, ",").alias("stack"))


def _labeled(name: str) -> str:
    line = f"list_filter(string_split(raw_text, chr(10)), lambda x: regexp_matches(x, '(?i)^{name} *: *[^ ]'))[1]"
    return f"CASE WHEN {line} IS NOT NULL THEN [concat('{name}=', regexp_extract({line}, ': *(.*)$', 1))] ELSE [] END"


@query(
    "extract_labeled_fields",
    with_views(
        ["posts"],
        "SELECT k, array_to_string("
        + " || ".join(_labeled(n) for n in ("company", "description", "location", "salary", "stack"))
        + ", ';') AS fields FROM posts",
    ),
)
def extract_labeled_fields(spark, folder):
    entries = F.array_sort(F.map_entries(extract.extract_labeled_fields(F.col("raw_text"))))
    joined = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return posts(spark, folder).select("k", joined.alias("fields"))


@query(
    "strip_labeled_lines",
    with_views(["posts"], "SELECT k, concat(title, chr(10), description) AS body FROM posts"),
)
def strip_labeled_lines(spark, folder):
    return posts(spark, folder).select("k", extract.strip_labeled_lines(F.col("raw_text")).alias("body"))


_NOUNS = "|".join(terms.ROLE_NOUNS)


@query(
    "guess_title",
    with_views(
        ["posts"],
        f"""SELECT k, coalesce(list_filter(l[1:8], lambda x: length(x) <= 90 AND regexp_matches(lower(x), '{_NOUNS}'))[1],
  list_filter(l[1:5], lambda x: length(x) BETWEEN 8 AND 90)[1], 'IT Vacancy') AS title
FROM (SELECT k, string_split(concat(description, chr(10), raw_text), chr(10)) AS l FROM posts)""",
    ),
)
def guess_title(spark, folder):
    message = F.concat("description", F.lit("\n"), "raw_text")
    return posts(spark, folder).select("k", extract.guess_title(message).alias("title"))


@query(
    "guess_location",
    with_views(
        ["posts"],
        """SELECT k, coalesce(regexp_extract(line, '(?i)location *: *(.*)$', 1),
  CASE WHEN lower(word) = 'remote' THEN 'Удаленно' ELSE word END) AS location
FROM (SELECT k, list_filter(string_split(t, chr(10)), lambda x: contains(lower(x), 'location'))[1] AS line,
  regexp_extract(t, '(?i)(remote|hybrid|onsite|relocation|europe|usa|us|uk|germany|poland)') AS word
  FROM (SELECT k, CASE k % 3 WHEN 0 THEN raw_text WHEN 1 THEN concat('Hybrid office, ', title)
    ELSE concat(title, ' (Remote, Poland)') END AS t FROM posts))""",
    ),
)
def guess_location(spark, folder):
    message = F.expr(
        "CASE k % 3 WHEN 0 THEN raw_text WHEN 1 THEN concat('Hybrid office, ', title) "
        "ELSE concat(title, ' (Remote, Poland)') END"
    )
    return posts(spark, folder).select("k", extract.guess_location(message).alias("location"))


_PARTS = (
    "list_filter(list_transform(regexp_split_to_array(v, '[,;/|]+'), lambda x: trim(x, ' •,;')), lambda x: x <> '') || "
    + _HITS.format("lower(v)")
)


@query(
    "parse_stack_value",
    with_views(
        ["posts"],
        f"""SELECT k, array_to_string({sql_unique('l')}, '+') AS stack
FROM (SELECT k, {_PARTS} AS l FROM (SELECT k, concat(description, ' / ', company, ';, Go') AS v FROM posts))""",
    ),
)
def parse_stack_value(spark, folder):
    value = F.concat("description", F.lit(" / "), "company", F.lit(";, Go"))
    return posts(spark, folder).select("k", F.array_join(extract.parse_stack_value(value), "+").alias("stack"))


@query(
    "ordered_array_union",
    with_views(
        ["posts"],
        f"""SELECT k, array_to_string({sql_unique('l')}, '+') AS words
FROM (SELECT k, string_split(title, ' ') || string_split(description, ' ') AS l FROM posts)""",
    ),
)
def ordered_array_union(spark, folder):
    union = extract.ordered_array_union(F.split("title", " "), F.split("description", " "))
    return posts(spark, folder).select("k", F.array_join(union, "+").alias("words"))


@query(
    "guess_salary",
    with_views(
        ["posts"],
        r"""SELECT k, nullif(trim(regexp_replace(regexp_extract(raw_text,
  '(?i)((?:\$|€|£)\s?\d[\d\s,.]*(?:\s?-\s?(?:\$|€|£)?\s?\d[\d\s,.]*)?|\d[\d\s,.]*\s?(?:usd|eur|gbp|rub|₽|k|тыс\.?)(?:\s?-\s?\d[\d\s,.]*\s?(?:usd|eur|gbp|rub|₽|k|тыс\.?))?)'),
  '\s+', ' ', 'g')), '') AS salary FROM posts""",
    ),
)
def guess_salary(spark, folder):
    return posts(spark, folder).select("k", extract.guess_salary(F.col("raw_text")).alias("salary"))


@query("clean_result_title", with_views(["posts"], "SELECT k, title FROM posts"))
def clean_result_title(spark, folder):
    suffix = F.element_at(F.array(*[F.lit(s) for s in terms.TITLE_SUFFIXES]), (F.col("k") % 4 + 1).cast("int"))
    return posts(spark, folder).select("k", extract.clean_result_title(F.concat("title", suffix)).alias("title"))


@query(
    "strip_hashtags",
    with_views(
        ["posts"],
        r"""SELECT k, trim(regexp_replace(regexp_replace(concat('#hiring ', title, ' c#dev #', source, ' -'),
  '(^|\W)#[\w.+-]+', '\1', 'g'), '\s+', ' ', 'g'), ' -|.,') AS title FROM posts""",
    ),
)
def strip_hashtags(spark, folder):
    tagged = F.concat(F.lit("#hiring "), "title", F.lit(" c#dev #"), "source", F.lit(" -"))
    return posts(spark, folder).select("k", extract.strip_hashtags(tagged).alias("title"))


_LEVEL = "(?:(?:junior|middle|mid-level|mid|senior|lead|staff|principal|trainee|intern)\\s+)?"
_FIELD = (
    "(?:front[-\\s]?end|frontend|back[-\\s]?end|backend|full[-\\s]?stack|software|cloud|python|java|golang|go"
    "|node(?:\\.js)?|react|vue|angular|typescript|javascript|mobile|ios|android|ml|ai|llm|machine\\s+learning|data)"
)
_NOUN = "(?:developer|engineer|architect|programmer)"
_ADJECTIVE_FIRST = f"(?i)\\b({_LEVEL}{_FIELD}\\s+{_NOUN}(?:\\s*\\([^)]+\\))?)\\b"
_NOUN_FIRST = f"(?i)\\b({_LEVEL}{_NOUN}\\s+{_FIELD}(?:\\s*\\([^)]+\\))?)\\b"
_SNIPPET = (
    "CASE k % 2 WHEN 0 THEN description ELSE concat(description, '. engineer Python (', location, ') wanted') END"
)


@query(
    "extract_role_title",
    with_views(
        ["posts"],
        f"""SELECT k, concat(upper(substr(role, 1, 1)), substr(role, 2)) AS title
FROM (SELECT k, coalesce(nullif(regexp_extract(t, {lit(_ADJECTIVE_FIRST)}, 1), ''),
  nullif(regexp_extract(t, {lit(_NOUN_FIRST)}, 1), ''), title) AS role
  FROM (SELECT k, title, concat(title, '. ', {_SNIPPET}) AS t FROM posts))""",
    ),
)
def extract_role_title(spark, folder):
    return posts(spark, folder).select("k", extract.post_title(F.col("title"), F.expr(_SNIPPET)).alias("title"))


_SCALAR = "CASE k % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN concat('  ', title, ' ') WHEN 3 THEN 'nat' ELSE url END"


@query(
    "clean_scalar",
    with_views(
        ["posts"],
        f"""SELECT k, CASE WHEN lower(trim(coalesce(v, ''))) IN ('nan', 'none', 'nat') THEN ''
  ELSE trim(coalesce(v, '')) END AS value FROM (SELECT k, {_SCALAR} AS v FROM posts)""",
    ),
)
def clean_scalar(spark, folder):
    value = text.clean_scalar(F.expr(_SCALAR), terms.EMPTY_SCALARS)
    return posts(spark, folder).select("k", value.alias("value"))


_TAGS = "[" + ", ".join(f"{{'l': {lit(label)}, 'm': {lit(marker)}}}" for label, marker in terms.TAG_MARKERS) + "]"
_TAGGED = (
    f"[{lit(terms.LEADING_TAG)}] || list_transform(list_filter({_TAGS}, lambda p: contains(lower(concat_ws(' ', title, "
    "description)), p.m)), lambda p: p.l)"
)


@query(
    "tag_marker_labels",
    with_views(
        ["posts"],
        f"SELECT k, array_to_string({sql_unique('l')}, ',') AS tags FROM (SELECT k, {_TAGGED} AS l FROM posts)",
    ),
)
def tag_marker_labels(spark, folder):
    tags = extract.tag_markers(F.concat_ws(" ", "title", "description"))
    return posts(spark, folder).select("k", F.array_join(tags, ",").alias("tags"))


_PARSED = f"""SELECT k, title, description, CASE WHEN url IS NULL THEN 'Telegram' ELSE 'LinkedIn' END AS source, url,
  concat('Remote ', location) AS location, company,
  array_to_string({sql_unique('l')}, ',') AS stack,
  regexp_extract(raw_text, 'Salary: (.*)', 1) AS salary, raw_text
FROM (SELECT *, {_PARTS} AS l FROM (SELECT *, regexp_extract(raw_text, 'Stack: (.*)', 1) AS v FROM posts))"""


@query("parse_posts", with_views(["posts"], _PARSED))
def parse_posts(spark, folder):
    parsed = jobs.parse_posts(posts(spark, folder).select("k", "raw_text"), "raw_text")
    return parsed.withColumn("stack", F.array_join("stack", ","))


@query(
    "intake_posts",
    with_views(
        ["posts"],
        "SELECT k, title, coalesce(url, CASE WHEN k % 2 = 0 AND k <> 0 THEN concat('https://t.me/', lower(source), '/', "
        "CAST(k AS VARCHAR)) END) AS url, CASE WHEN url IS NULL THEN 'Telegram' ELSE 'LinkedIn' END AS source FROM posts "
        f"WHERE {sql_any('raw_text', terms.ALLOWED_ROLE_TERMS)} AND NOT {sql_any('raw_text', terms.DENIED_ROLE_TERMS)}",
    ),
)
def intake_posts(spark, folder):
    """Messages forwarded from a channel; every other one names it."""
    messages = posts(spark, folder).selectExpr(
        "k", "raw_text AS text", "CASE WHEN k % 2 = 0 THEN lower(source) END AS origin_username", "k AS origin_message_id"
    )
    return jobs.intake_posts(messages).select("k", "title", "url", "source")


_AS_POST = f"""SELECT position, url, coalesce(nullif(regexp_extract(t, {lit(_ADJECTIVE_FIRST)}, 1), ''), title) AS title,
  snippet AS description, provider AS source, published_epoch
FROM (SELECT *, regexp_replace(search_title, ' - LinkedIn$', '') AS title,
  concat(search_title, '. ', snippet) AS t, {epoch('published_at')} AS published_epoch FROM cands)"""


@query(
    "candidates_to_posts",
    with_views(["cands"], _AS_POST.replace("search_title, '. '", "regexp_replace(search_title, ' - LinkedIn$', ''), '. '")),
)
def candidates_as_posts(spark, folder):
    found = candidates(spark, folder).drop("published_at")
    cleaned = found.withColumn("search_title", extract.clean_result_title(F.col("search_title")))
    return candidates_to_posts(cleaned).select(
        "position", "url", "title", "description", "source", F.unix_seconds("published_at").alias("published_epoch")
    )


@query(
    "scraped_to_posts",
    with_views(
        ["cands"],
        "SELECT position, url, title, description, 'Scraper' AS source, published_epoch FROM ("
        + _AS_POST.replace("search_title, '. '", "regexp_replace(search_title, ' - LinkedIn$', ''), '. '")
        + ") WHERE published_epoch IS NOT NULL AND url <> ''",
    ),
)
def scraped_as_posts(spark, folder):
    found = candidates(spark, folder).selectExpr(
        "position", "search_title AS title", "url AS link", "snippet", "date_text"
    )
    return scraped_to_posts(found, "Scraper").select(
        "position", "url", "title", "description", "source", F.unix_seconds("published_at").alias("published_epoch")
    )


@query(
    "identity_and_fingerprint",
    with_views(
        ["prints"],
        "SELECT k, coalesce(lower(url), lower(concat_ws('|', title, company, location, description))) AS identity, "
        "fingerprint FROM prints",
    ),
)
def identity_and_fingerprint(spark, folder):
    names = ("url", "title", "company", "location", "description")
    return posts(spark, folder).select(
        "k", identity_source(*(F.col(n) for n in names)).alias("identity"), post_fingerprint().alias("fingerprint")
    )


@query(
    "trim_text",
    r"""SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE concat(rtrim(substr(t, 1, 279)), '...') END AS trimmed
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
)
def trim_text(spark, folder):
    return documents(spark, folder).select("doc_id", text.trim_text(F.col("text"), 280).alias("trimmed"))


def _escaped(value: str) -> str:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = f"replace({value}, {lit(char)}, {lit(reference)})"
    return value


CARD_SQL = (
    f"concat('💼 <b>', {_escaped('title')}, '</b>', chr(10), chr(10), '🏢 <b>Компания</b>: ', {_escaped('company')}, "
    f"chr(10), chr(10), '📍 <b>Локация</b>: ', {_escaped('location')}, "
    "chr(10), chr(10), '🧠 <b>Стек</b>: ', {0}, chr(10), chr(10), '<b>Описание</b>', chr(10), "
    f"{_escaped('description')}, CASE WHEN url IS NULL THEN '' ELSE concat(chr(10), chr(10), '🔗 <a href=\"', "
    f"{_escaped('url')}, '\"><b>Смотреть вакансию</b></a>') END, chr(10), '▫️ Источник: ', {_escaped('source')})"
)


@query(
    "render_card",
    with_views(
        ["posts"],
        "SELECT k, "
        + CARD_SQL.format(_escaped("array_to_string(string_split(description, ' ')[1:3], ', ')"))
        + " AS card FROM (SELECT * REPLACE (concat(title, ' & <', source, '> \"x\" ''y''') AS title) FROM posts)",
    ),
)
def render_card(spark, folder):
    title = F.concat("title", F.lit(" & <"), "source", F.lit("> \"x\" 'y'"))
    card = cards.render_card(
        title, F.col("company"), F.col("location"), F.lit(""), F.split("description", " "), F.col("description"),
        F.col("url"), F.col("source"), max_tags=3,
    )
    return posts(spark, folder).select("k", card.alias("card"))


@query(
    "script_ratio",
    """SELECT doc_id, accented, letters, letters > 0 AND accented / letters < 0.05 AS below,
  letters > 0 AND accented / letters >= 0.05 AS reached
FROM (SELECT doc_id, length(regexp_replace(text, '[^À-ÿ]', '', 'g')) AS accented,
  length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) AS letters FROM documents)""",
)
def script_ratio(spark, folder):
    body = F.col("text")
    return documents(spark, folder).select(
        "doc_id",
        text.count_chars(body, "À-ÿ").cast("bigint").alias("accented"),
        text.count_chars(body, "A-Za-zÀ-ÿ").cast("bigint").alias("letters"),
        text.script_below(body, "À-ÿ", "A-Za-zÀ-ÿ", 0.05).alias("below"),
        text.script_reached(body, "À-ÿ", "A-Za-zÀ-ÿ", 0.05).alias("reached"),
    )


@query(
    "comparable_text",
    "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-zA-ZЀ-ӿ0-9]+'), ' ') AS comparable FROM documents",
)
def comparable_text(spark, folder):
    return documents(spark, folder).select("doc_id", text.comparable_text(F.col("text")).alias("comparable"))


@query(
    "public_origin_url",
    """SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id <> 0 THEN concat('https://t.me/user/',
  CAST(conv_id AS VARCHAR)) END AS url FROM conversations""",
)
def public_origin_url(spark, folder):
    username = F.when(F.col("role") == "user", F.col("role"))
    return conversations(spark, folder).select(
        "conv_id", "turn", urls.public_origin_url(username, F.col("conv_id")).alias("url")
    )


@query(
    "array_head",
    with_views(
        ["posts"],
        """SELECT k, array_to_string(string_split(raw_text, ' ')[1:18], ' ') AS head, url AS first_url FROM posts""",
    ),
)
def array_head(spark, folder):
    first = F.try_element_at(urls.extract_urls(F.col("raw_text")), F.lit(1))
    return posts(spark, folder).select(
        "k", F.array_join(F.slice(F.split("raw_text", " "), 1, terms.MAX_CARD_TAGS), " ").alias("head"),
        first.alias("first_url"),
    )


# ---------------------------------------------------------------- dates
def _date_texts(spark, folder):
    """Event times written in the forms the sources use."""
    events = table(spark, folder, "events")
    seconds = dates.epoch_seconds(events, "ts")
    form = F.col("event_id") % 8
    wall = F.col("ts")
    written = (
        F.when(form == 0, F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(form == 1, seconds.cast("string"))
        .when(form == 2, F.concat(seconds.cast("string"), F.lit("000")))
        .when(form == 3, F.concat(F.date_format(wall, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(form == 4, F.date_format(wall, "MMM d, yyyy"))
        .when(form == 5, F.date_format(wall, "MMMM d, yyyy"))
        .when(form == 6, F.concat(F.date_format(wall, "yyyy-MM-dd HH:mm"), F.lit("+02:00")))
        .otherwise(F.lit("2 days ago"))
    )
    activity = seconds * 1000 * 4194304 + F.col("event_id") % 1000
    link = F.concat(F.lit("https://www.linkedin.com/posts/x-activity-"), activity.cast("string"), F.lit("-ab"))
    return events.select("event_id", written.alias("date_text"), link.alias("url"), seconds.alias("seconds"))


def _date_sql(days: bool, otherwise: str) -> str:
    day = "CAST(epoch(date_trunc('day', ts)) AS BIGINT)" if days else "NULL"
    return f"""CASE WHEN event_id % 8 < 4 THEN {epoch('ts')} WHEN event_id % 8 < 6 THEN {day}
  WHEN event_id % 8 = 6 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) - 7200 ELSE {otherwise} END"""


@query("parse_source_datetime", f"SELECT event_id, {_date_sql(False, 'NULL')} AS seconds FROM events")
def parse_source_datetime(spark, folder):
    parsed = dates.parse_source_datetime(F.col("date_text"))
    return _date_texts(spark, folder).select("event_id", F.unix_seconds(parsed).alias("seconds"))


@query("parse_search_date", f"SELECT event_id, {_date_sql(True, 'NULL')} AS seconds FROM events")
def parse_search_date(spark, folder):
    parsed = dates.parse_search_date(F.col("date_text"))
    return _date_texts(spark, folder).select("event_id", F.unix_seconds(parsed).alias("seconds"))


@query("timestamp_from_activity_id", f"SELECT event_id, {epoch('ts')} AS seconds FROM events")
def timestamp_from_activity_id(spark, folder):
    parsed = dates.timestamp_from_activity_id(F.col("url"))
    return _date_texts(spark, folder).select("event_id", F.unix_seconds(parsed).alias("seconds"))


@query("resolve_published_at", f"SELECT event_id, {_date_sql(True, epoch('ts'))} AS seconds FROM events")
def resolve_published_at(spark, folder):
    parsed = dates.resolve_published_at(F.col("date_text"), F.col("url"))
    return _date_texts(spark, folder).select("event_id", F.unix_seconds(parsed).alias("seconds"))


_BUCKET = (
    "CASE WHEN h <= 1 THEN 'qdr:h' WHEN h <= 24 THEN 'qdr:d' WHEN h <= 168 THEN 'qdr:w' WHEN h <= 744 THEN 'qdr:m' "
    "ELSE 'qdr:y' END"
)


@query(
    "recency_bucket",
    with_views(
        ["posts"],
        f"SELECT k, CASE WHEN h IS NOT NULL THEN {_BUCKET} END AS age_class FROM (SELECT k, "
        "CAST((epoch(TIMESTAMP '2001-08-01') - epoch(published_at)) / 3600 AS BIGINT) AS h FROM posts)",
    ),
)
def recency_bucket(spark, folder):
    rows = posts(spark, folder)
    hours = (F.lit(int(NOW.timestamp())) - dates.epoch_seconds(rows, "published_at")) / 3600
    return rows.select("k", F.when(hours.isNotNull(), dates.recency_bucket(hours)).alias("age_class"))


@query(
    "resolve_dates",
    f"""SELECT event_id, seconds, h AS age_hours, CASE WHEN h IS NOT NULL THEN {_BUCKET} END AS age_class
FROM (SELECT event_id, seconds, CAST(ceil((1707000000 - seconds) / 3600) AS BIGINT) AS h
  FROM (SELECT event_id, {_date_sql(True, epoch('ts'))} AS seconds FROM events))""",
)
def resolve_dates(spark, folder):
    from datetime import UTC, datetime

    rows = jobs.resolve_dates(_date_texts(spark, folder).drop("seconds"), now=datetime.fromtimestamp(1707000000, UTC))
    return rows.select("event_id", F.unix_seconds("published_at").alias("seconds"), "age_hours", "age_class")

