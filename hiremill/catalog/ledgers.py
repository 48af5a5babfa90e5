"""Queries of the ledgers and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hiremill import terms
from hiremill.catalog.base import ORACLES, ledger, posts, query, table, updates, with_views
from hiremill.operators import applications, profiles
from hiremill.operators.dedupe import with_fingerprint
from hiremill.plans import jobs
from hiremill.session import work_folder
from hiremill.sources import keyed
from hiremill.sources.ledger import evolve_ledger, lookup_published_url, rows_to_publish


@query(
    "append_published",
    with_views(
        ["prints", "ledger"],
        "SELECT fingerprint, title, source, url FROM prints WHERE fingerprint NOT IN (SELECT fingerprint FROM ledger) "
        "QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY k) = 1",
    ),
)
def append_published(spark, folder):
    return rows_to_publish(with_fingerprint(posts(spark, folder)), ledger(spark, folder), [F.col("k")])


@query(
    "ledger_maintenance",
    with_views(
        ["prints", "ledger"],
        "SELECT fingerprint, title, source, url FROM ledger UNION ALL (SELECT fingerprint, title, source, url FROM prints "
        "WHERE fingerprint NOT IN (SELECT fingerprint FROM ledger) "
        "QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY k) = 1)",
    ),
)
def ledger_maintenance(spark, folder):
    return jobs.ledger_maintenance(posts(spark, folder), ledger(spark, folder), ["k"])


@query(
    "lookup_published_url",
    with_views(
        ["updates", "ledger"],
        "SELECT update_id, url AS published_url FROM updates LEFT JOIN ledger ON vacancy_id = fingerprint",
    ),
)
def published_urls(spark, folder):
    return lookup_published_url(updates(spark, folder), ledger(spark, folder)).select("update_id", "published_url")


_EXISTING = "operator_user_id = 0 AND update_id % 5 = 0"


@query(
    "insert_applications",
    with_views(
        ["updates", "ledger"],
        f"""SELECT substr(sha256(concat(CAST(operator_user_id AS VARCHAR), '|', vacancy_id)), 1, 16) AS application_id,
  operator_user_id, vacancy_id AS vacancy_fingerprint, url AS vacancy_url,
  CASE WHEN url IS NOT NULL THEN 'www.linkedin.com' END AS site,
  CASE WHEN url IS NULL THEN 'failed' ELSE 'created' END AS status,
  CASE WHEN url IS NULL THEN '{terms.NO_URL_ERROR}' END AS error_description
FROM (SELECT DISTINCT operator_user_id, vacancy_id FROM updates WHERE kind = 'apply') JOIN ledger ON vacancy_id = fingerprint
WHERE (operator_user_id, vacancy_id) NOT IN (SELECT (operator_user_id, vacancy_id) FROM updates
  WHERE {_EXISTING} AND vacancy_id IS NOT NULL)""",
    ),
)
def insert_applications(spark, folder):
    feed = updates(spark, folder)
    held = feed.filter(_EXISTING).selectExpr("operator_user_id", "vacancy_id AS vacancy_fingerprint")
    return applications.insert_applications(feed.filter("kind = 'apply'"), ledger(spark, folder), held)


@query(
    "update_application_status",
    """SELECT o_orderkey AS application_id, CASE WHEN n IS NULL THEN 'created' ELSE s END AS status,
  CASE WHEN n IS NULL THEN NULL ELSE e END AS error_description
FROM orders LEFT JOIN (SELECT event_id // 3 AS id, max(event_id) AS n, arg_max(event_type, event_id) AS s,
  max_by(struct_pack(v := CASE WHEN event_id % 2 = 0 THEN props END), event_id).v AS e FROM events GROUP BY 1)
  ON o_orderkey = id""",
)
def update_application_status(spark, folder):
    begun = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS application_id", "'created' AS status", "CAST(NULL AS STRING) AS error_description"
    )
    changes = table(spark, folder, "events").selectExpr(
        "event_id div 3 AS application_id", "event_id AS seq", "event_type AS status",
        "CASE WHEN event_id % 2 = 0 THEN props END AS error",
    )
    return applications.update_application_status(begun, changes)


@query(
    "valid_status",
    with_views(
        ["updates"],
        "SELECT update_id FROM updates WHERE outcome IN ('submitted', 'loading', 'submitting', 'failed', 'queued', "
        "'manual_required')",
    ),
)
def valid_status(spark, folder):
    return updates(spark, folder).filter(applications.valid_status(F.col("outcome"))).select("update_id")


# ---------------------------------------------------------------- profiles
def _configured(spark, folder):
    """Profiles as first stored: one per customer, version -1."""
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS operator_user_id", "CAST(-1 AS BIGINT) AS version", "c_name AS full_name",
        "CAST(NULL AS STRING) AS email", "c_mktsegment AS location",
    )


_FIELDS = ("full_name", "email", "location")


@query(
    "upsert_profiles",
    """SELECT coalesce(c_custkey, user_id) AS operator_user_id,
  CASE WHEN user_id IS NULL THEN c_name ELSE r.t END AS full_name,
  CASE WHEN user_id IS NULL THEN NULL ELSE r.p END AS email,
  CASE WHEN user_id IS NULL THEN c_mktsegment ELSE 'moved' END AS location,
  CASE WHEN c_custkey IS NULL THEN lo ELSE -1 END AS created_version, coalesce(hi, -1) AS updated_version
FROM customer FULL JOIN (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi,
  max_by(struct_pack(t := event_type, p := CASE WHEN value > 10 THEN props END), event_id) AS r
  FROM events GROUP BY user_id) ON c_custkey = user_id""",
)
def upsert_profiles(spark, folder):
    return profiles.upsert_profiles(_configured(spark, folder), _profile_changes(spark, folder), _FIELDS)


@query(
    "patch_profiles",
    """SELECT c_custkey AS operator_user_id, coalesce(n.v, c_name) AS full_name, e.v AS email,
  CASE WHEN l.seen THEN l.v ELSE c_mktsegment END AS location, -1 AS created_version, coalesce(hi, -1) AS updated_version
FROM customer LEFT JOIN (SELECT user_id, max(event_id) AS hi FROM events GROUP BY 1) a ON a.user_id = c_custkey
LEFT JOIN (SELECT user_id, arg_max(props, event_id) AS v FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1) n
  ON n.user_id = c_custkey
LEFT JOIN (SELECT user_id, arg_max(props, event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1) e
  ON e.user_id = c_custkey
LEFT JOIN (SELECT user_id, true AS seen, max_by(struct_pack(v := CASE WHEN value > 10 THEN props END), event_id).v AS v
  FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) l ON l.user_id = c_custkey""",
)
def patch_profiles(spark, folder):
    patches = table(spark, folder, "events").selectExpr(
        "user_id AS operator_user_id", "event_id AS version",
        "CASE WHEN event_type IN ('click', 'signup') THEN 'full_name' WHEN event_type = 'view' THEN 'email' "
        "ELSE 'location' END AS field",
        "CASE WHEN event_type IN ('purchase', 'error') AND value <= 10 THEN NULL ELSE props END AS value",
    )
    known = patches.join(_configured(spark, folder).select("operator_user_id"), "operator_user_id", "left_semi")
    return profiles.patch_profiles(_configured(spark, folder), known, _FIELDS)


_KEYED = "operator_user_id bigint, full_name string, email string, location string, created_version bigint, updated_version bigint"


def _profile_changes(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "user_id AS operator_user_id", "event_id AS version", "event_type AS full_name",
        "CASE WHEN value > 10 THEN props END AS email", "'moved' AS location",
    )


@query("keyed_profiles", ORACLES["upsert_profiles"])
def keyed_profiles(spark, folder):
    """The same upserts in three changes of a stored table, each of which rewrites the buckets it meets."""
    path = work_folder(spark, "profiles")
    first = _configured(spark, folder).selectExpr(
        "operator_user_id", *_FIELDS, "version AS created_version", "version AS updated_version"
    )
    keyed.write_keyed(first, path, "operator_user_id")
    changes = _profile_changes(spark, folder)
    for number in range(3):
        keyed.change_keyed(
            spark, path, _KEYED, "operator_user_id", changes.where(F.pmod("version", F.lit(3)) == number),
            lambda rows, new: profiles.merge_profiles(rows, new, _FIELDS),
        )
    return keyed.read_keyed(spark, path, _KEYED)


_STATUSES = "application_id bigint, status string, error_description string"


@query("keyed_statuses", ORACLES["update_application_status"])
def keyed_statuses(spark, folder):
    """Status changes applied to a stored table in two stretches, the later after the earlier."""
    path = work_folder(spark, "statuses")
    begun = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS application_id", "'created' AS status", "CAST(NULL AS STRING) AS error_description"
    )
    keyed.write_keyed(begun, path, "application_id")
    changes = table(spark, folder, "events").selectExpr(
        "event_id div 3 AS application_id", "event_id AS seq", "event_type AS status",
        "CASE WHEN event_id % 2 = 0 THEN props END AS error",
    )
    half = changes.agg(F.max("seq")).first()[0] // 2
    for stretch in (F.col("seq") <= half, F.col("seq") > half):
        keyed.change_keyed(
            spark, path, _STATUSES, "application_id", changes.where(stretch), applications.update_application_status
        )
    return keyed.read_keyed(spark, path, _STATUSES)


_EXTRA_JSON = (
    "CASE WHEN c_nationkey % 3 = 0 THEN concat('{\"segment\": \"', c_mktsegment, '\", \"name\": \"', c_name, '\"}') "
    "WHEN c_nationkey % 3 = 1 THEN concat('{\"key\": ', c_custkey, '}') ELSE '{}' END"
)


@query(
    "read_profiles",
    """SELECT c_custkey AS operator_user_id, c_nationkey % 3 <> 1 AS extra_fields_valid,
  CASE c_nationkey % 3 WHEN 0 THEN concat('name=', c_name, ';segment=', c_mktsegment) WHEN 2 THEN '' END AS extra_fields
FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
)
def read_profiles(spark, folder):
    stored = table(spark, folder, "customer").selectExpr(
        "c_custkey AS operator_user_id", f"{_EXTRA_JSON} AS extra_fields_json"
    )
    wanted = table(spark, folder, "events").selectExpr("user_id AS operator_user_id")
    found = profiles.read_profiles(stored, wanted)
    entries = F.array_sort(F.map_entries("extra_fields"))
    shown = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("operator_user_id", "extra_fields_valid", shown.alias("extra_fields"))


@query(
    "delete_profiles",
    "SELECT c_custkey AS operator_user_id FROM customer WHERE c_custkey NOT IN "
    "(SELECT user_id FROM events WHERE event_type = 'error')",
)
def delete_profiles(spark, folder):
    removed = table(spark, folder, "events").filter("event_type = 'error'").selectExpr("user_id AS operator_user_id")
    return profiles.delete_profiles(_configured(spark, folder), removed).select("operator_user_id")


@query(
    "delete_hits",
    "SELECT DISTINCT user_id + 1000 AS operator_user_id, user_id + 1000 IN (SELECT c_custkey FROM customer) AS deleted "
    "FROM events",
)
def delete_hits(spark, folder):
    removed = table(spark, folder, "events").selectExpr("user_id + 1000 AS operator_user_id")
    return profiles.delete_hits(_configured(spark, folder), removed)


_ENTRY = (
    "CASE event_id % 7 WHEN 0 THEN concat(' ', event_type, ' ') WHEN 1 THEN concat(' : ', props) "
    "WHEN 2 THEN concat(event_type, ':  ') ELSE concat(event_type, ' ', {key}, ' : ', props) END"
)


@query(
    "parse_extra_fields",
    f"""SELECT user_id, string_agg(concat(name, '=', value), ';' ORDER BY name) AS extra_fields FROM (
  SELECT user_id, name, arg_max(value, event_id) AS value FROM (
    SELECT user_id, event_id, trim(split_part(t, ':', 1)) AS name, trim(substr(t, strpos(t, ':') + 1)) AS value
    FROM (SELECT user_id, event_id, {_ENTRY.format(key="CAST(event_id % 17 AS VARCHAR)")} AS t FROM events)
    WHERE contains(t, ':')) WHERE name <> '' AND value <> '' GROUP BY user_id, name
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) <= 20) GROUP BY user_id""",
)
def parse_extra_fields(spark, folder):
    entries = table(spark, folder, "events").selectExpr(
        "user_id", "event_id", f"{_ENTRY.format(key='CAST(event_id % 17 AS STRING)')} AS text"
    )
    found = profiles.parse_extra_fields(entries, "user_id", "event_id")
    pairs = F.array_sort(F.map_entries("extra_fields"))
    shown = F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("user_id", shown.alias("extra_fields"))


_PROFILE_VALUE = (
    "CASE event_id % 5 WHEN 0 THEN concat(' ', event_type, ' ') WHEN 1 THEN '  ' WHEN 2 THEN ' {skip} ' "
    "WHEN 3 THEN repeat('x', 250 + CAST(event_id % 13 AS INTEGER)) END"
)


@query(
    "clean_profile_value",
    f"""SELECT event_id, CASE WHEN t NOT IN ('', '{terms.SKIP_TEXT}') AND length(t) <= 256 THEN t END AS value,
  length(t) <= 256 AS valid
FROM (SELECT event_id, coalesce(trim({_PROFILE_VALUE.format(skip=terms.SKIP_TEXT)}), '') AS t FROM events)""",
)
def clean_profile_value(spark, folder):
    entries = table(spark, folder, "events").selectExpr(
        "event_id", f"{_PROFILE_VALUE.format(skip=terms.SKIP_TEXT)} AS text"
    )
    return entries.select("event_id", profiles.clean_profile_value(F.col("text")).alias("v")).select("event_id", "v.*")


@query(
    "evolve_ledger",
    with_views(
        ["prints"],
        "SELECT fingerprint, title, NULL AS url, NULL AS note FROM prints WHERE published_at IS NULL UNION ALL "
        "SELECT fingerprint, title, url, source FROM prints WHERE published_at IS NOT NULL",
    ),
)
def evolve(spark, folder):
    rows = with_fingerprint(posts(spark, folder))
    first = rows.filter("published_at IS NULL").select("fingerprint", "title")
    second = rows.filter("published_at IS NOT NULL").selectExpr("fingerprint", "title", "url", "source AS note")
    return evolve_ledger(first, second)
