"""Ratcliff-Obershelp similarity. Spark has no such function, so it runs as an Arrow batch UDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiremill.functions.text import comparable_text, let


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right, strict=True)
        ],
        dtype="float64",
    )


def text_similarity(left: Column, right: Column) -> Column:
    return _ratio(comparable_text(left), comparable_text(right))


def too_similar(left: Column, right: Column, needed: Column, threshold: float) -> Column:
    """Similarity at or above the threshold.

    The ratio cannot exceed ``2 * shorter / (left + right)``, so only needed pairs of
    near lengths are sent to Python; every other row travels as null.
    """
    pair = F.when(needed, F.struct(comparable_text(left).alias("a"), comparable_text(right).alias("b")))

    def worth(texts: Column) -> Column:
        shorter = F.least(F.length(texts["a"]), F.length(texts["b"]))
        total = F.length(texts["a"]) + F.length(texts["b"])
        return F.when((total == 0) | (2 * shorter >= threshold * total), texts)

    near = let(pair, worth)
    return F.coalesce(_ratio(near["a"], near["b"]) >= threshold, F.lit(False))
