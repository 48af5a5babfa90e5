"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiremill.llm.common import bounded_sample, free_name, held_out, once, text_slices, unit_hash

#: Bytes of a window; it ends at the next space, so that a word is never cut.
WINDOW = 64
LEVEL = 12
DICTIONARY_BYTES = 16384
TOXIC_BYTES = 16384
#: Letters of a character sequence that marks toxic words.
GRAM = 5
#: Such a sequence has this many contexts in toxic text, and this many times the share it has in ordinary text.
LEAST_CONTEXTS = 5
LEAST_RATIO = 15
#: Margins of a window, in bytes, that count as evidence.
MARGINS = (2, 4)
#: The bounded sample a model is fit on: rows per label, and characters of a row at most.
SAMPLE_ROWS = {1: 1200, 0: 2400}
SAMPLE_CHARS = 40_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries with the same ordinary content, one with toxic content before it, and a calibration."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        values = features(window_margins(texts, self.ordinary, self.toxic))
        return 1 / (1 + np.exp(-np.clip(values @ np.array(self.weights), -30, 30)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def window_spans(data: np.ndarray, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of windows over bytes that begin and end with a space; both ends keep theirs.

    A window ends at the first space after a multiple of `window` bytes, or after two more windows
    where there is no space, so that a text without spaces is cut all the same.
    """
    window = window or WINDOW
    if len(data) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    spaces = np.flatnonzero(data == 32)
    grid = np.arange(0, len(data), window)
    first = spaces[np.minimum(np.searchsorted(spaces, grid), len(spaces) - 1)]
    bounds = np.unique(np.append(np.minimum(first, np.minimum(grid + 2 * window, len(data) - 1)), len(data) - 1))
    return bounds[:-1], np.diff(bounds) + 1


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return once(("compressor", content, LEVEL), lambda: _new_compressor(content))


def _new_compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _lengths(content: bytes, data: bytes, spans: np.ndarray) -> np.ndarray:
    found = _compressor(content).multi_compress_to_buffer(
        zstandard.BufferWithSegments(data, spans.astype("<u8").tobytes()), threads=0
    )
    return np.fromiter((len(found[i]) for i in range(len(spans))), dtype=np.int64, count=len(spans))


def window_margins(texts: Sequence[str | None], ordinary: bytes, toxic: bytes) -> list[np.ndarray]:
    """For each text, the bytes each of its windows saves under the toxic dictionary."""
    out: list[np.ndarray] = []
    parts: list[bytes] = []
    spans: list[np.ndarray] = []
    counts: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if spans and sum(counts):
            data, where = b"".join(parts), np.concatenate(spans)
            margins = _lengths(ordinary, data, where) - _lengths(toxic, data, where)
        else:
            margins = np.empty(0, dtype=np.int64)
        out.extend(np.split(margins, np.cumsum(counts)[:-1]) if counts else [])
        parts.clear()
        spans.clear()
        counts.clear()
        size = 0

    for text in texts:
        words = words_of(text)
        data = b" " + b" ".join(words) + b" " if words else b""
        starts, lengths = window_spans(np.frombuffer(data, dtype=np.uint8))
        parts.append(data)
        spans.append(np.stack([starts + size, lengths], axis=1))
        counts.append(len(starts))
        size += len(data)
        if size > 1 << 23:
            flush()
    flush()
    return out


def features(margins: Sequence[np.ndarray]) -> np.ndarray:
    """Per text: one, the largest margin, how many windows reach each of MARGINS, how many there are."""
    rows = np.zeros((len(margins), 3 + len(MARGINS)))
    rows[:, 0] = 1
    for i, own in enumerate(margins):
        if len(own):
            rows[i, 1] = np.clip(own.max(), 0, 12)
            rows[i, 2:-1] = [np.log1p((own >= m).sum()) for m in MARGINS]
            rows[i, -1] = np.log1p(len(own))
    return rows


# ---------------------------------------------------------------- training
def _contexts(texts: Sequence[list[bytes]]) -> tuple[Counter, Counter, int]:
    """How many contexts (a word between its neighbours) hold each marked sequence and each word.

    A context counts once however often it is repeated, so copies of a text add nothing.
    """
    seen: set[tuple[bytes, bytes, bytes]] = set()
    for words in texts:
        around = [b"", *words, b""]
        seen.update(zip(around, around[1:], around[2:], strict=False))
    words = Counter(bare(word) for _, word, _ in seen)
    grams: Counter = Counter()
    for word, n in words.items():
        for gram in word_grams(word):
            grams[gram] += n
    return grams, words, max(1, len(seen))


def bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]")


def word_grams(word: bytes) -> set[bytes]:
    edged = b" " + word + b" "
    return {edged[i : i + GRAM] for i in range(len(edged) - GRAM + 1)}


def toxic_content(toxic: Sequence[list[bytes]], ordinary: Sequence[list[bytes]]) -> bytes:
    """The stretches of toxic words that sequences far more frequent there than in ordinary texts cover.

    The most frequent come last, where zstandard reaches them at the least cost.
    """
    in_toxic, toxic_words, n_toxic = _contexts(toxic)
    in_ordinary, _, n_ordinary = _contexts(ordinary)
    marks = {
        g for g, n in in_toxic.items()
        if n >= LEAST_CONTEXTS and n / n_toxic >= LEAST_RATIO * (in_ordinary[g] + 1) / n_ordinary
    }
    stretches: Counter = Counter()
    for word, n in toxic_words.items():
        edged = b" " + word + b" "
        start = end = 0
        for i in range(len(edged) - GRAM + 1):
            if edged[i : i + GRAM] in marks:
                if i > end:
                    stretches[edged[start:end]] += n
                    start = i
                end = i + GRAM
                start = start if end > start + GRAM else i
        stretches[edged[start:end]] += n
    del stretches[b""]
    ordered = sorted(stretches, key=lambda w: (stretches[w], w))
    return b"".join(ordered)[-TOXIC_BYTES:]


def ordinary_content(texts: Sequence[list[bytes]]) -> bytes:
    """A trained dictionary of ordinary windows; the windows themselves where there are too few to train on."""
    windows = [b" ".join(words[i : i + 8]) + b" " for words in texts for i in range(0, len(words), 8)]
    windows = [w for w in windows if len(w) >= 8]
    if sum(map(len, windows)) < 16 * DICTIONARY_BYTES:
        return b"".join(windows)[-DICTIONARY_BYTES:]
    return zstandard.train_dictionary(DICTIONARY_BYTES, windows, level=3).as_bytes()


def fit_logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first column, the constant, is not penalised."""
    beta = np.zeros(rows.shape[1])
    penalty = np.full(rows.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (weights * (labels - p)) - penalty * beta
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(texts: Sequence[str], labels: Sequence[int], parts: Sequence[float], shares: dict[int, float]) -> ToxicityModel:
    """A model from a sample: two thirds make the dictionaries, the rest calibrates.

    `parts` is a number in [0, 1) per row that says which; `shares` are the shares of the labels in
    all labelled rows, which the calibration weighs the sample back to.
    """
    y = np.array(labels, dtype=float)
    if not (y == 1).any() or not (y == 0).any():
        share = float(y.mean()) if len(y) else 0.0
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return ToxicityModel(b"", b"", (float(odds), *[0.0] * (2 + len(MARGINS))))
    words = [words_of(t) for t in texts]
    first = np.array(parts) < 2 / 3
    if not all((first & (y == v)).any() and (~first & (y == v)).any() for v in (0, 1)):
        first = np.ones(len(y), dtype=bool)
    toxic_words = [w for w, a, v in zip(words, first, y, strict=True) if a and v == 1]
    ordinary_words = [w for w, a, v in zip(words, first, y, strict=True) if a and v == 0]
    ordinary = ordinary_content(ordinary_words)
    toxic = toxic_content(toxic_words, ordinary_words) + ordinary
    rest = ~first if (~first).any() else first
    rows = features(window_margins([t for t, a in zip(texts, rest, strict=True) if a], ordinary, toxic))
    labels_left = y[rest]
    weights = np.array([shares[int(v)] / max(1, (labels_left == v).sum()) for v in labels_left]) * len(labels_left)
    return ToxicityModel(ordinary, toxic, tuple(fit_logistic(rows, labels_left, weights).tolist()))


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    sample_rows: dict[int, int] = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    At most twice `sample_rows` rows per label and `sample_chars` characters each reach the driver.
    A null label is none; an id with several labels counts as toxic if one says so.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label_"))
    )
    counts = {r["label_"]: r["count"] for r in known.groupBy("label_").count().collect()}
    total = sum(counts.values())
    chosen = bounded_sample(known, "label_", 0, ["doc_id"], seed=8, most=sample_rows).collect()
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["doc_id"], r["label_"]) for r in chosen], "id_ long, label_ int")
    rows = (
        docs.where(F.col(text).isNotNull() & (F.length(text) <= sample_chars))
        .join(F.broadcast(wanted), F.col(doc_id) == F.col("id_"))
        .select("id_", F.col(text).alias("text_"), "label_", unit_hash(F.col("id_"), seed=9).alias("part_"))
        # repeated ids: the bound is kept by the order of the rows, not by their place
        .orderBy("id_", F.xxhash64("text_"), "text_")
        .limit(2 * sum(sample_rows.values()))
        .collect()
    )
    rows.sort(key=lambda r: (r["id_"], r["text_"]))
    return fit(
        [r["text_"] for r in rows], [r["label_"] for r in rows], [r["part_"] for r in rows],
        {v: counts.get(v, 0) / max(total, 1) for v in (0, 1)},
    )


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with the model's score of their whole text."""
    ordinary, toxic, weights = model.ordinary, model.toxic, model.weights

    @F.arrow_udf("double")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ToxicityModel(ordinary, toxic, weights)
        for batch in batches:
            scores = [own.scores(texts) for texts in text_slices(batch)]
            yield pa.array(np.concatenate([np.empty(0), *scores]), pa.float64())

    return docs.withColumn(name, compute(F.col(text)))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Defined cases: null, empty and space-only texts have no window and get the score of the
    calibration's constant; without toxic or without ordinary training rows every score is the share
    of toxic labels; a null id is not held out; repeated rows stay repeated; an empty table gives an
    empty result; other columns are ignored.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, all columns."""
    name = free_name(docs, "toxicity_score_")
    return with_score(docs, train(docs, labels), name=name).where(F.col(name) < threshold).select(docs.columns)
