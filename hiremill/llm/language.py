"""Language identification: the nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.common import bounded_sample, held_out, once

UNKNOWN = "und"
#: Hashed features of character sequences of one to three letters and word edges.
BITS = 13
SIZE = 1 << BITS
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected below this quantile of the training texts' cosines to their own language.
REJECT_QUANTILE = 0.005
#: The bounded sample a model is fit on: rows per language, and characters of a row at most.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 20_000
#: Texts and characters worked on at a time.
BATCH_TEXTS, BATCH_CHARS = 256, 1 << 21


def _letters() -> np.ndarray:
    """For each code point the code point itself if it is a letter, a space if not."""
    return once(
        "letters", lambda: np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)
    )


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return ((mixed * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def gram_counts(texts: Sequence[str]) -> np.ndarray:
    """A row of hashed n-gram counts per text; sequences of spaces alone do not count."""
    codes = [_codes(t) for t in texts]
    gap = np.full(2, 32, dtype=np.uint32)
    data = _letters()[np.concatenate([x for own in codes for x in (gap, own)] + [gap, gap])].astype(np.uint32)
    lengths = np.array([len(own) + 2 for own in codes])
    row = np.repeat(np.arange(len(codes)), lengths) * SIZE
    one, two, three = data[: len(row)], data[1 : len(row) + 1], data[2 : len(row) + 2]
    spaces = one == 32
    counts = np.zeros(len(codes) * SIZE, dtype=np.int64)
    pair = one * np.uint32(131) + two
    for mixed, keep in (
        (one, ~spaces),
        (pair + np.uint32(0x10000000), ~(spaces & (two == 32))),
        (pair * np.uint32(131) + three + np.uint32(0x20000000), ~(spaces & (two == 32) | (two == 32) & (three == 32))),
    ):
        counts += np.bincount((row + _bucket(mixed))[keep], minlength=len(counts))
    return counts.reshape(len(codes), SIZE)


def split_batches(texts: Sequence[str | None]) -> Iterator[list[str]]:
    """Runs of texts of bounded number and size; a null is an empty text."""
    own: list[str] = []
    size = 0
    for text in texts:
        own.append(text or "")
        size += len(own[-1])
        if len(own) >= BATCH_TEXTS or size >= BATCH_CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


def unit_rows(values: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        return unit_rows(np.log1p(gram_counts(texts)) * self.idf)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to the nearest centroid and whether that is too far, for each text."""
        names: list[str] = []
        scores: list[np.ndarray] = []
        far: list[np.ndarray] = []
        for batch in split_batches(texts):
            spoken = np.array([any(c.isalpha() for c in t) for t in batch])
            if not self.languages or not spoken.any():
                names += [UNKNOWN] * len(batch)
                scores.append(np.zeros(len(batch)))
                far.append(np.ones(len(batch), dtype=bool))
                continue
            cosines = self.vectors(batch) @ self.centroids.T
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(batch)), best], 0, 1)
            names += [self.languages[self.owner[b]] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)]
            scores.append(np.where(spoken, score, 0.0))
            far.append(~spoken | (score < self.least[self.owner[best]]))
        return names, np.concatenate(scores or [np.empty(0)]), np.concatenate(far or [np.empty(0, dtype=bool)])


def cluster(rows: np.ndarray, number: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, begun with the row nearest the mean and then the rows farthest from those chosen."""
    centre = [int((rows @ rows.mean(axis=0)).argmax())]
    near = rows @ rows[centre[0]]
    while len(centre) < min(number, len(rows)):
        centre.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[centre[-1]])
    centroids = rows[centre]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(axis=1)
        sums = np.stack([rows[own == k].sum(axis=0) for k in range(len(centroids))])
        held = np.linalg.norm(sums, axis=1) > 0
        centroids = unit_rows(sums[held])
    return centroids


def fit(texts: Sequence[str], languages: Sequence[str], centroids: int = CENTROIDS) -> LanguageModel:
    """Centroids of each language's texts; texts without letters teach nothing."""
    pairs = [(t, v) for t, v in zip(texts, languages, strict=True) if t and any(c.isalpha() for c in t)]
    names = tuple(sorted({v for _, v in pairs}))
    empty = np.empty((0, SIZE))
    if not pairs:
        return LanguageModel((), np.ones(SIZE), empty, np.empty(0, dtype=int), np.empty(0))
    counts = np.concatenate([np.log1p(gram_counts(b)).astype(np.float32) for b in split_batches([t for t, _ in pairs])])
    idf = np.log((1 + len(pairs)) / (1 + (counts > 0).sum(axis=0))) + 1
    rows = unit_rows(counts * idf.astype(np.float32))
    spoken = np.array([names.index(v) for _, v in pairs])
    found, owner, least = [], [], []
    for k in range(len(names)):
        own = cluster(rows[spoken == k], centroids)
        found.append(own)
        owner += [k] * len(own)
        least.append(np.quantile((rows[spoken == k] @ own.T).max(axis=1), REJECT_QUANTILE))
    return LanguageModel(names, idf, np.concatenate(found), np.array(owner), np.array(least))


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
) -> LanguageModel:
    """Fit on about `sample_rows` rows per language, of at most `sample_chars` characters, outside the held-out fold."""
    known = docs.where(
        F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) <= sample_chars) & ~held_out(F.col(doc_id))
    ).select(F.col(text).alias("text_"), F.col(lang).alias("lang_"), F.col(doc_id).alias("id_"))
    rows = bounded_sample(known, "lang_", sample_rows, ["id_", "text_"], seed=4).collect()
    rows.sort(key=lambda r: (r["lang_"], r["text_"]))
    return fit([r["text_"] for r in rows], [r["lang_"] for r in rows])


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The documents with a struct column `language`: lang_pred, score, rejected. A column of that name is replaced."""
    languages, idf, centroids, owner, least = (
        model.languages, model.idf, model.centroids.astype(np.float64), model.owner, model.least,
    )

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(languages, idf, centroids, owner, least)
        for batch in batches:
            names, scores, far = own.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores, "rejected": far})

    return docs.withColumn("language", compute(F.col(text)))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is a language of the training rows, or `und` if the text is null or has no letter (or
    nothing could be learned); score is the cosine to the nearest centroid, 0 for `und`; rejected says
    that the text lies farther from that language than nearly all of its training texts. Ties go to
    the language first in order. A null id is not held out; repeated rows stay repeated; an empty
    table gives an empty result; other columns are ignored.
    """
    found = with_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
