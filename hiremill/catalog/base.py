"""Tables the registered queries run on: views over the given Parquet tables, for both engines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill.functions import dates
from hiremill.operators.dedupe import first_wins, with_fingerprint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2001, 8, 1, tzinfo=UTC)
MAX_AGE_HOURS = 24 * 730
CUTOFF_SQL = "TIMESTAMP '1999-08-02 00:00:00'"
LEDGER_UNTIL = "1997-06-01 00:00:00"
OPERATORS = (0, 1)
MAX_UPLOAD_BYTES = 5_000_000
PROVIDERS = {
    "click": "AUTOMOBILE", "view": "BUILDING", "signup": "FURNITURE", "purchase": "HOUSEHOLD", "error": "MACHINERY",
}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Session setting: partitions that the given tables are dealt to before heavy text work. A table of one file with
#: one row group is one task otherwise. Without it tables are read as they lie, which is right for large ones.
DEAL_TO = "spark.hiremill.dealTo"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows of a table, dealt by a key where the session asks for it."""
    parts = df.sparkSession.conf.get(DEAL_TO, None)
    return df.repartition(int(parts), key) if parts else df


# ---------------------------------------------------------------- SQL helpers
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sql_any(text: str, terms: Sequence[str]) -> str:
    """Lowercase text contains any of the terms."""
    return f"list_bool_or(list_transform({sql_list(terms)}, lambda t: contains(lower({text}), t)))"


def sql_unique(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def with_views(views: Sequence[str], select: str) -> str:
    """The select with the named views, and the views those need, as CTEs in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        words = VIEWS[name].replace(",", " ").split()
        for other in VIEWS:
            if other != name and other in words:
                add(other)
        needed.append(name)

    for view in views:
        add(view)
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed) + "\n" + select


# ---------------------------------------------------------------- posts
_POST_COLUMNS = """
  o_orderkey AS k, c_mktsegment AS source, o_custkey % 3 AS source_rank, c_name AS company, n_name AS location,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE concat('https://www.linkedin.com/posts/x-', CAST(o_orderkey % 3000 AS {text})) END AS url,
  concat(CASE o_orderkey % 4 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Junior' WHEN 2 THEN 'Lead' ELSE 'Staff' END, ' ',
    CASE o_orderkey % 6 WHEN 0 THEN 'Backend Engineer' WHEN 1 THEN 'DevOps Engineer' WHEN 2 THEN 'Python Developer'
      WHEN 3 THEN 'Product Manager' WHEN 4 THEN 'React Developer' ELSE 'QA Automation Engineer' END) AS title,
  concat('Build services with ', CASE o_orderkey % 5 WHEN 0 THEN 'Python and Django' WHEN 1 THEN 'React, TypeScript'
    WHEN 2 THEN 'Go' WHEN 3 THEN 'PostgreSQL' ELSE 'Kubernetes' END, ' in ', n_name) AS description,
  CASE o_orderkey % 3 WHEN 0 THEN 'Python, FastAPI' WHEN 1 THEN 'React/TypeScript' ELSE 'Go; PostgreSQL' END AS stack_text,
  CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS {text}) AS salary_txt,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS published_at
"""
_RAW_TEXT = """
  concat(title, chr(10), 'Company: ', company, chr(10), 'Location: Remote ', location, chr(10),
    'Stack: ', stack_text, chr(10), 'Salary: $', salary_txt, chr(10), 'Description:', chr(10), description,
    CASE WHEN url IS NULL THEN '' ELSE concat(chr(10), url, '.') END) AS raw_text
"""
_POST_OUT = "k, k AS position, source, source_rank, url, title, company, location, description, published_at"


def _expressions(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, start, quoted = [], 0, 0, False
    for at, char in enumerate(text):
        if char == "'":
            quoted = not quoted
        elif not quoted and char in "()":
            depth += 1 if char == "(" else -1
        elif not quoted and char == "," and depth == 0:
            parts.append(text[start:at])
            start = at + 1
    return [part.strip() for part in [*parts, text[start:]]]


def posts_from_orders(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    """Postings made of orders, customers and nations; ``orders`` may be a stream."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    rows = joined.selectExpr(*_expressions(_POST_COLUMNS.format(text="STRING")))
    return rows.selectExpr(*_expressions(_POST_OUT), _RAW_TEXT.strip())


def posts(spark: SparkSession, folder: str) -> DataFrame:
    return posts_from_orders(spark, folder, dealt(table(spark, folder, "orders"), "o_orderkey"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents"), "doc_id")


def web_pages(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "pages"), "page_id")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "conversations"), "conv_id")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What was published before: the older posts, each fingerprint once."""
    older = posts(spark, folder).filter(f"published_at < TIMESTAMP_NTZ '{LEDGER_UNTIL}'")
    rows = first_wins(with_fingerprint(older), ["fingerprint"], [F.col("k")])
    return rows.select("fingerprint", "title", "source", "url")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return posts(spark, folder).selectExpr(
        "coalesce(url, '') AS url",
        "concat(title, ' - LinkedIn') AS search_title",
        "description AS snippet",
        "CASE WHEN published_at IS NULL THEN '' ELSE concat(date_format(published_at, 'yyyy-MM-dd'), 'T00:00:00Z') END"
        " AS date_text",
        "source AS provider",
        "concat('q', CAST(k % 12 AS STRING)) AS query",
        "concat('f', CAST(k % 12 AS STRING)) AS family",
        "concat('l', CAST(k % 2 AS STRING)) AS language",
        "k AS position",
        "published_at",
    )


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per provider request; every request of the failing provider is an error."""
    cases = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in PROVIDERS.items())
    return table(spark, folder, "events").selectExpr(
        f"CASE event_type {cases} END AS provider",
        "event_id AS ord",
        "event_type <> 'error' AND (event_type = 'click' OR value >= 5) AS ok",
        "CASE WHEN value < 2 THEN 'Client Error!' ELSE 'TimeoutError' END AS error_name",
        "CASE WHEN value < 1 THEN 429 END AS status_code",
        "CASE WHEN value < 2 THEN 'Client_Error_' ELSE 'TimeoutError' END AS error_type",
    )


_UPDATE_COLUMNS = """
  event_id AS update_id, user_id % 3 AS operator_user_id,
  CASE event_type WHEN 'view' THEN 'resume' WHEN 'error' THEN 'other' ELSE 'apply' END AS kind,
  CASE WHEN event_id % 97 = 0 THEN 'not-an-id' WHEN event_id % 89 = 0 THEN substring({sha}, 1, 32)
       ELSE fingerprint END AS vacancy_id,
  CASE event_id % 6 WHEN 0 THEN 'submitted' WHEN 1 THEN 'loading' WHEN 2 THEN 'submitting' WHEN 3 THEN 'failed'
       WHEN 4 THEN 'queued' ELSE 'manual_required' END AS outcome,
  CASE event_id % 6 WHEN 3 THEN 'Browser preparation failed.' WHEN 5 THEN 'Site protection detected.' END AS outcome_error,
  CASE WHEN value < 5 THEN 'group' ELSE 'private' END AS chat_type,
  CASE event_id % 5 WHEN 0 THEN 'cv.pdf' WHEN 1 THEN 'cv.DOCX' WHEN 2 THEN '../cv.pdf' WHEN 3 THEN NULL
       ELSE 'cv.txt' END AS file_name,
  CAST(floor(value * 100000) AS BIGINT) AS file_size
"""


def updates_from_events(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """Update feed: sixteen updates in a row concern the same post."""
    from hiremill.operators.filters import upload_reason

    known = with_fingerprint(posts(spark, folder)).select("k", "fingerprint")
    joined = events.join(known, F.expr("event_id div 16") == F.col("k"), "left")
    rows = joined.selectExpr(*_expressions(_UPDATE_COLUMNS.format(sha="sha2(CAST(event_id AS STRING), 256)")))
    reason = upload_reason(
        F.col("operator_user_id"), F.col("chat_type"), F.col("file_name"), F.col("file_size"),
        operators=OPERATORS, max_bytes=MAX_UPLOAD_BYTES,
    )
    return rows.withColumn("upload_reason", reason)


def updates(spark: SparkSession, folder: str) -> DataFrame:
    return updates_from_events(spark, folder, table(spark, folder, "events"))


def cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Search cycles in which anything happened."""
    events = table(spark, folder, "events")
    return events.select(dates.cycle_number(events, "ts").alias("cycle")).distinct()


def epoch(column: str) -> str:
    """Whole seconds since 1970, as DuckDB writes it."""
    return f"CAST(floor(epoch({column})) AS BIGINT)"


_FINGERPRINT = (
    "substr(sha256(coalesce(lower(trim(nullif(url, ''))), concat_ws('|', lower(trim(nullif(title, ''))), "
    "lower(trim(nullif(company, ''))), lower(trim(nullif(location, ''))), "
    "lower(trim(nullif(substr(description, 1, 240), '')))))), 1, 32)"
)
_PROVIDER_CASE = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in PROVIDERS.items())

# the same views in DuckDB
VIEWS: dict[str, str] = {
    "post_rows": f"SELECT {_POST_COLUMNS.format(text='VARCHAR')} FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey",
    "posts": f"SELECT {_POST_OUT}, {_RAW_TEXT} FROM post_rows",
    "prints": f"SELECT *, {_FINGERPRINT} AS fingerprint FROM posts",
    "ledger": "SELECT fingerprint, arg_min(title, k) AS title, arg_min(source, k) AS source, first(url) AS url "
    f"FROM prints WHERE published_at < TIMESTAMP '{LEDGER_UNTIL}' GROUP BY fingerprint",
    "cands": "SELECT coalesce(url, '') AS url, concat(title, ' - LinkedIn') AS search_title, description AS snippet, "
    "CASE WHEN published_at IS NULL THEN '' ELSE concat(strftime(published_at, '%Y-%m-%d'), 'T00:00:00Z') END "
    "AS date_text, source AS provider, concat('f', CAST(k % 12 AS VARCHAR)) AS family, "
    "concat('l', CAST(k % 2 AS VARCHAR)) AS language, k AS position, published_at FROM posts",
    "qlog": f"SELECT CASE event_type {_PROVIDER_CASE} END AS provider, event_id AS ord, "
    "event_type <> 'error' AND (event_type = 'click' OR value >= 5) AS ok, "
    "CASE WHEN value < 2 THEN 'Client Error!' ELSE 'TimeoutError' END AS error_name, "
    "CASE WHEN value < 1 THEN 429 END AS status_code, "
    "CASE WHEN value < 2 THEN 'Client_Error_' ELSE 'TimeoutError' END AS error_type FROM events",
    "feed": f"SELECT {_UPDATE_COLUMNS.format(sha='sha256(CAST(event_id AS VARCHAR))')} "
    "FROM events LEFT JOIN prints ON event_id // 16 = k",
    "updates": "SELECT *, CASE WHEN operator_user_id NOT IN (0, 1) THEN 'unauthorized' "
    "WHEN chat_type <> 'private' THEN 'not_private' WHEN file_name IS NULL THEN 'no_document' "
    r"WHEN NOT regexp_full_match(file_name, '(?i)[^/]+\.(pdf|docx)') THEN 'bad_name' "
    f"WHEN file_size > {MAX_UPLOAD_BYTES} THEN 'too_large' END AS upload_reason FROM feed",
    "cycles": "SELECT DISTINCT CAST(floor(epoch(ts) / 900) AS BIGINT) AS cycle FROM events",
}
