"""Joins. No broadcast hints: Spark broadcasts a side when its measured size allows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiremill.functions.identity import valid_fingerprint
from hiremill.functions.text import strip
from hiremill.session import stored


def authorized_only(
    df: DataFrame, allowed: DataFrame | Sequence[int], user: str = "user_id", *, when_empty: str = "everyone"
) -> DataFrame:
    """Rows of allowed users. An empty list means everyone (intake) or nobody (profiles)."""
    if when_empty not in ("everyone", "nobody"):
        raise ValueError(f"unknown mode: {when_empty}")
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select(F.col(allowed.columns[0]).alias(user)), user, "left_semi")
    if not allowed:
        return df if when_empty == "everyone" else df.filter(F.lit(False))
    return df.filter(F.col(user).isin(*allowed))


def request_to_post(requests: DataFrame, ledger: DataFrame, vacancy: str = "vacancy_id") -> DataFrame:
    """Well-formed requests with the title, source and URL of the published post they name.

    The ledger holds a fingerprint once; a post that attracts very many requests is
    split by the adaptive skew join.
    """
    posts = ledger.select(
        F.col("fingerprint").alias(vacancy), F.col("url").alias("vacancy_url"),
        F.col("title").alias("vacancy_title"), F.col("source").alias("vacancy_source"),
    )
    return requests.filter(valid_fingerprint(F.col(vacancy))).join(posts, vacancy, "inner")


def term_match(
    texts: DataFrame, dictionary: DataFrame, *, key: str, text: str = "text", term: str = "term"
) -> DataFrame:
    """(key, term) for every dictionary term a text contains, for dictionaries too large for one pattern.

    Substring search as an equi-join: a term is filed under one sequence of three of its characters (the whole
    term, if it is shorter), the one fewest terms have. Of the sequences of a text only those that a Bloom
    filter of the filed ones knows leave the scan; they meet the terms there, each beside its text, in which longer terms
    are then searched. The filter has a fixed size, whatever the dictionary's, and is all that reaches the
    driver. No text is paired with the whole dictionary, and a term may have any length. The filed terms are
    stored, so that Spark knows their size when it chooses the join.
    """
    words = dictionary.select(F.col(term), F.lower(F.col(term)).alias("_term")).filter(F.length("_term") > 0).distinct()
    filed = words.withColumn("_gram", F.explode(_filed_grams(F.col("_term"))))
    spread = F.count(F.lit(1)).over(Window.partitionBy("_gram"))
    rarest = filed.withColumn("_n", spread).groupBy(term, "_term").agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    rarest = stored(rarest, "filed-terms")
    known = _gram_filter(rarest)
    grams = [_filtered(_sequences(F.col("_text"), size), bits) for size, bits in sorted(known.items())]
    found = F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<string>")
    # an outer explode: of an inner one Spark would test the size first, and compute all sequences twice
    pieces = texts.select(key, F.lower(F.col(text)).alias("_text")).select(key, "_text", F.explode_outer(found).alias("_gram"))
    met = pieces.join(rarest, "_gram").filter((F.col("_term") == F.col("_gram")) | F.contains(F.col("_text"), F.col("_term")))
    return met.select(key, term).distinct()


#: Characters of a sequence that terms are filed under, and bits of the filter of each length.
_GRAM = 3
_FILTER_BITS = 1 << 20


def _sequences(text: Column, size: int) -> Column:
    """Every sequence of so many characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _filed_grams(term: Column) -> Column:
    """The sequences a term may be filed under; a short term is one itself."""
    return F.when(F.length(term) >= _GRAM, F.array_distinct(_sequences(term, _GRAM))).otherwise(F.array(term))


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(_FILTER_BITS)).cast("int")


def _gram_filter(rarest: DataFrame) -> dict[int, Column]:
    """For each length of a filed sequence the words of its filter, 64 bits each."""
    places = rarest.select(F.length("_gram").alias("size"), _place(F.col("_gram")).alias("place"))
    bit = F.expr("shiftleft(1L, place % 64)")
    words = places.groupBy("size", F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found: dict[int, list[int]] = {}
    for row in words.collect():
        found.setdefault(row["size"], [0] * (_FILTER_BITS // 64))[row["word"]] = row["bits"]
    return {size: F.from_json(F.lit(json.dumps(bits)), "array<bigint>") for size, bits in found.items()}


def _filtered(grams: Column, bits: Column) -> Column:
    """The sequences whose bit is set."""

    def held(place: Column) -> Column:
        return F.getbit(F.get(bits, F.shiftright(place, 6)), F.pmod(place, F.lit(64))) == 1

    return F.filter(grams, lambda gram: held(_place(gram)))


def intent_quota_zip(intents: DataFrame, quotas: DataFrame, keys: Sequence[str] = ("intent_pos",)) -> DataFrame:
    """Every intent with its quota, by position."""
    return intents.join(quotas, list(keys), "inner")


def profile_with_defaults(profiles: DataFrame, stored: DataFrame, key: str = "operator_user_id") -> DataFrame:
    """Configured profiles completed by stored ones.

    The resume name follows whichever side supplied the file: a stored name without a
    stored file is not used. Of the configured values, full_name and email are trimmed, a blank
    phone is null, and personal_url and cover_letter that are not blank become extra_fields.
    """
    texts = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("full_name", "email") if c in profiles.columns}
    if "phone" in profiles.columns:
        texts["phone"] = F.nullif(strip(F.col("phone")), F.lit(""))
    extra = [c for c in ("personal_url", "cover_letter") if c in profiles.columns]
    if extra:
        pairs = [F.struct(F.lit(c).alias("key"), strip(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in extra]
        texts["extra_fields"] = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"] != ""))
    profiles = profiles.withColumns(texts).drop(*extra)
    resume = stored.select(
        key,
        F.nullif(F.col("resume_file_id"), F.lit("")).alias("_file"),
        F.col("resume_original_name").alias("_name"),
    )
    own = F.col("_file").isNotNull()
    return (
        profiles.join(resume, key, "left")
        .withColumn("resume_original_name", F.when(own, F.col("_name")).otherwise(F.col("resume_original_name")))
        .withColumn(
            "resume_file_id",
            F.when(own, F.col("_file")).otherwise(F.nullif(F.trim("resume_file_id"), F.lit(""))),
        )
        .drop("_file", "_name")
    )


def outcome_to_application(applications: DataFrame, outcomes: DataFrame, key: str = "application_id") -> DataFrame:
    """Applications with the worker's outcome; without one they keep their status."""
    result = outcomes.select(
        key, F.col("status").alias("_status"), F.col("error").alias("_error")
    )
    done: Column = F.col("_status").isNotNull()
    return (
        applications.join(result, key, "left")
        .withColumn("error_description", F.when(done, F.col("_error")).otherwise(F.col("error_description")))
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status", "_error")
    )
