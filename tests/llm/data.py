"""Small tables with the odd cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that was with this from have not but they were which their said would there".split(),
    "de": "der die und das den von mit sich des auf für ist im dem nicht ein eine als auch nach".split(),
}


def sentence(rng: random.Random, lang: str, words: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(("", "", "ing", "heit")[: 3 if lang == "en" else 4]) for _ in range(words))


def documents(spark: SparkSession, rows: int = 60, extra: bool = True) -> DataFrame:
    """Ordinary rows, then nulls in every column, empty and space-only texts, a very long one, ties and repeats."""
    rng = random.Random(5)
    out = []
    for i in range(rows):
        lang = "en" if i % 3 else "de"
        text = sentence(rng, lang, rng.randint(5, 120)) + ("\n" if i % 4 else ".")
        out.append((i, text, lang, f"s{i % 4}", len(text)))
    if extra:
        out += [
            (1000, None, "en", "s0", None),
            (1001, "", "de", None, 0),
            (1002, " \t\n ", None, None, 4),
            (1003, sentence(rng, "en", 30_000), "en", "s1", 1),
            (1004, "x" * 200_000, None, "s2", 1),
            (1005, "!!! 123 ... 😀  ", "en", "s2", 1),
            (None, "a text without an id, of some words", "en", "s3", 1),
            (None, None, None, None, None),
            (1006, out[0][1], "en", "s3", 1),
            (1007, out[0][1].upper(), "en", "s3", 1),
            out[3],
            out[3],
        ]
    return spark.createDataFrame(out, SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with columns named like those the operators add."""
    from pyspark.sql import functions as F

    names = [
        "size", "shard", "slot", "score", "predicted", "fp", "fingerprint", "component", "component_id", "node", "low",
        "row_id", "copies", "target", "start", "language", "held_out", "kept", "hit", "item", "words", "host", "lines",
        "leaks_", "toxicity_score_", "row_", "copy_",
    ]
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
