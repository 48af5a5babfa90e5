"""Operator profiles: upserts, patches, reads, deletes and free-form fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill import terms
from hiremill.functions.text import let, strip
from hiremill.operators.dedupe import first_n
from hiremill.operators.once import select_where

KEY = "operator_user_id"


def upsert_profiles(
    current: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = KEY, version: str = "version"
) -> DataFrame:
    """Full-row upsert: the latest version of every profile; its creation is kept, its update moves on.

    Rows are aggregated per key before and after the shuffle, so a profile that changes
    very often costs no more than one row per task.
    """
    rows = current.select(key, version, *fields).unionByName(changes.select(key, version, *fields))
    latest = rows.groupBy(key).agg(
        F.max_by(F.struct(*fields), version).alias("_row"),
        F.min(version).alias("created_version"),
        F.max(version).alias("updated_version"),
    )
    return latest.select(key, "_row.*", "created_version", "updated_version")


def merge_profiles(
    stored: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = KEY, version: str = "version"
) -> DataFrame:
    """The same on profiles that an earlier upsert left: what they were created and last updated by goes on."""
    rows = stored.select(key, F.col("updated_version").alias(version), "created_version", *fields).unionByName(
        changes.select(key, version, F.col(version).alias("created_version"), *fields)
    )
    latest = rows.groupBy(key).agg(
        F.max_by(F.struct(*fields), version).alias("_row"),
        F.min("created_version").alias("created_version"),
        F.max(version).alias("updated_version"),
    )
    return latest.select(key, "_row.*", "created_version", "updated_version")


def patch_profiles(
    current: DataFrame, patches: DataFrame, fields: Sequence[str], key: str = KEY, version: str = "version"
) -> DataFrame:
    """Partial updates. A patch names one field; the other fields of the profile are carried over.

    patches: key, version, field, value (null clears the field).
    """
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    base = current.select(key, version, F.explode(entries).alias("_e")).select(key, version, "_e.field", "_e.value")
    every = base.unionByName(patches.select(key, version, "field", "value"))
    values = [
        F.max_by(F.struct("value"), F.when(F.col("field") == f, F.col(version))).getField("value").alias(f) for f in fields
    ]
    return every.groupBy(key).agg(
        *values, F.min(version).alias("created_version"), F.max(version).alias("updated_version")
    )


def extra_fields_valid(text: Column) -> Column:
    """The stored JSON is an object whose values are all strings."""
    values = F.map_values(F.from_json(text, "map<string,variant>"))
    kinds = F.transform(values, lambda v: F.schema_of_variant(v))
    return F.coalesce(F.forall(kinds, lambda kind: kind == "STRING"), F.lit(False))


def read_profiles(profiles: DataFrame, wanted: DataFrame, key: str = KEY) -> DataFrame:
    """Profiles of the wanted keys with their free-form fields decoded; invalid ones are marked."""
    found = profiles.join(wanted.select(key).distinct(), key, "left_semi")
    valid = extra_fields_valid(F.col("extra_fields_json"))
    return found.withColumn("extra_fields_valid", valid).withColumn(
        "extra_fields",
        F.when(F.col("extra_fields_valid"), F.from_json("extra_fields_json", "map<string,string>")),
    )


def delete_profiles(profiles: DataFrame, removed: DataFrame, key: str = KEY) -> DataFrame:
    """The profile table without the removed keys."""
    return profiles.join(removed.select(key), key, "left_anti")


def delete_hits(profiles: DataFrame, removed: DataFrame, key: str = KEY) -> DataFrame:
    """Every key asked to be removed and whether a profile was there."""
    held = profiles.select(key).distinct().withColumn("_held", F.lit(True))
    asked = removed.select(key).distinct()
    return asked.join(held, key, "left").select(key, F.coalesce("_held", F.lit(False)).alias("deleted"))


def clean_profile_value(
    value: Column, skip: str = terms.SKIP_TEXT, max_chars: int = terms.MAX_EXTRA_VALUE_CHARS
) -> Column:
    """Struct of the trimmed value, null where blank or skipped, and whether it is short enough to keep."""

    def clean(text: Column) -> Column:
        kept = F.when((text != "") & (text != skip) & (F.length(text) <= max_chars), text)
        return F.struct(kept.alias("value"), (F.length(text) <= max_chars).alias("valid"))

    return let(strip(F.coalesce(value, F.lit(""))), clean)


def parse_extra_fields(
    entries: DataFrame,
    owner: str,
    order: str,
    text: str = "text",
    *,
    max_name: int = terms.MAX_EXTRA_NAME_CHARS,
    max_value: int = terms.MAX_EXTRA_VALUE_CHARS,
    max_fields: int = terms.MAX_EXTRA_FIELDS,
) -> DataFrame:
    """Map of ``name: value`` entries per owner.

    An owner's first ``max_fields`` names are kept and later entries of those names
    overwrite the value, which is what adding them one by one to a full profile gives.
    """
    pattern = r"(?s)^([^:]*):(.*)\z"
    columns = {
        owner: F.col(owner),
        order: F.col(order),
        "name": strip(F.regexp_extract(text, pattern, 1)),
        "value": strip(F.regexp_extract(text, pattern, 2)),
    }
    valid = select_where(
        entries.filter(F.contains(F.col(text), F.lit(":"))),
        columns,
        lambda row: F.length(row["name"]).between(1, max_name) & F.length(row["value"]).between(1, max_value),
    )
    last = valid.groupBy(owner, "name").agg(F.min(order).alias("_first"), F.max_by("value", order).alias("value"))
    kept = first_n(last, [owner], [F.col("_first"), F.col("name")], max_fields)
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return kept.groupBy(owner).agg(F.map_from_entries(pairs).alias("extra_fields"))
