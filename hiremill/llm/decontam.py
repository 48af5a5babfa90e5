"""Benchmark decontamination: CGK embeddings of windows of benchmark items, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.llm.common import free_name, stored

#: Part of an item's words that may differ.
EDIT_SHARE = 0.2
#: Part of the items with as many edits as allowed that the repetitions of each class are to find.
RECALL = 0.98


@dataclass(frozen=True)
class SizeClass:
    """Items of at least `least` words: words of a window and between windows, sampled steps, repetitions."""

    least: int
    window: int
    apart: int
    samples: int
    repetitions: int


#: Repetitions with which each class reaches RECALL on items edited as much as allowed (tests/llm/test_leaks.py
#: measures it); items under five words allow no edit.
CLASSES = (
    SizeClass(1, 1, 1, 1, 1),
    SizeClass(2, 2, 1, 2, 1),
    SizeClass(4, 4, 2, 4, 1),
    SizeClass(5, 4, 1, 3, 8),
    SizeClass(8, 6, 1, 5, 7),
    SizeClass(16, 8, 1, 6, 6),
    SizeClass(25, 12, 3, 7, 8),
)
#: Items held by one index; a larger benchmark is searched one block after another.
BLOCK_ITEMS = 20_000
#: Words of documents worked on at a time.
CHUNK_WORDS = 1 << 18
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case without ASCII marks; words end at the six ASCII spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()


def word_codes(words: Sequence[bytes]) -> np.ndarray:
    """A number above zero for each word; zero stands for the space between and after texts."""
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) | np.uint32(1)


@dataclass(frozen=True)
class Walk:
    """One repetition for windows of at least `prefix` words: a random bit per step and word, and sampled steps."""

    prefix: int
    factors: np.ndarray
    samples: np.ndarray

    def step(self, number: int, words: np.ndarray) -> np.ndarray:
        """Whether the walk goes on to the next word, a bit that the step and the word decide."""
        return (words * self.factors[number]) >> np.uint32(31)


def class_of(words: int) -> SizeClass:
    return [c for c in CLASSES if c.least <= words][-1]


def walks(kind: SizeClass) -> list[Walk]:
    """The repetitions for one size class.

    The walk of a window writes its current word at every step and then, by a random bit of step and
    word, stays or moves on. Windows at a small edit distance agree at most steps: after an edit the
    walks fall in step again. Agreement at all of a few sampled steps makes a candidate. The first
    repetitions sample early steps only, which every window of the class reaches.
    """
    steps = max(1, kind.window + kind.window // 2)
    out = []
    for number in range(kind.repetitions):
        rng = np.random.default_rng([7, kind.window, kind.least, number])
        factors = (rng.integers(0, 1 << 32, steps, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        first = number % min(3, kind.window)
        pool = np.arange(first + 1, kind.window if number < 2 else steps)
        chosen = rng.choice(pool, size=min(kind.samples - 1, len(pool)), replace=False) if len(pool) else []
        out.append(Walk(kind.window, factors, np.sort(np.append(chosen, first)).astype(int)))
    return out


def _mixed(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = (key ^ words.astype(np.uint64)) * _MIX
    return key ^ (key >> np.uint64(29))


@dataclass(frozen=True)
class Index:
    """Items and, for each repetition, the sampled keys of their windows."""

    items: tuple[int | None, ...]
    codes: tuple[np.ndarray, ...]
    sizes: tuple[int, ...]
    walks: tuple[Walk, ...]
    gates: tuple[tuple[np.ndarray, ...], ...]
    keys: tuple[np.ndarray, ...]
    owners: tuple[np.ndarray, ...]

    # ------------------------------------------------------------ search
    def candidates(self, codes: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of the item in `codes`, item, text of the window) of windows that agree with a window of an item.

        `texts` is the text of each start: an item cut off at either end may reach beyond the text its words are in.
        """
        found = [np.empty((0, 3), dtype=np.int64)]
        for walk, gates, keys, owners in zip(self.walks, self.gates, self.keys, self.owners, strict=True):
            at = place = starts
            text = texts
            key = np.zeros(len(starts), dtype=np.uint64)
            taken = 0
            for step in range(walk.samples[-1] + 1):
                words = codes[at]
                if step == walk.samples[taken]:
                    key = _mixed(key, words)
                    gate = gates[taken]
                    kept = np.flatnonzero(gate[(key >> np.uint64(40)).astype(np.int64) & (len(gate) - 1)])
                    key, at, place, text, words = key[kept], at[kept], place[kept], text[kept], words[kept]
                    taken += 1
                    if not len(kept):
                        break
                at = at + walk.step(step, words)
            if not len(key):
                continue
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            count = high - low
            hit = np.repeat(np.arange(len(key)), count)
            entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[hit]
            found.append(np.stack([place[hit] - owners[entry, 1], owners[entry, 0], text[hit]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1], pairs[:, 2]

    def search(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text the items in it: (item, first word, edit distance), each item once at its closest."""
        out: list[list[tuple[int, int, int]]] = []
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size >= CHUNK_WORDS:
                out += self._search(held)
                held, size = [], 0
        return out + self._search(held)

    def _search(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        if not texts or not self.items:
            return [[] for _ in texts]
        reach = max(len(w.factors) for w in self.walks) + 1
        lengths = np.array([len(words) for words in texts])
        offsets = np.cumsum(lengths + reach) - lengths - reach
        codes = np.zeros(int((lengths + reach).sum()) + reach, dtype=np.uint32)
        starts = np.repeat(offsets, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[starts] = word_codes([w for words in texts for w in words])
        at, item, owner = self.candidates(codes, starts, np.repeat(np.arange(len(texts)), lengths))
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for place, number, doc in zip(at.tolist(), item.tolist(), owner.tolist(), strict=True):
            size = self.sizes[number]
            known = best[doc].get(number)
            if known and known[0] == 0:
                continue
            begin, end = int(offsets[doc]), int(offsets[doc] + lengths[doc])
            slack = max(1, int(EDIT_SHARE * size))
            distance = self._distance(codes, max(begin, place - slack), max(begin, min(end, place + size + slack)), number)
            found = None if distance is None else (distance, max(place - begin, 0))
            if found and (known is None or found < known):
                best[doc][number] = found
        return [sorted((n, first, distance) for n, (distance, first) in own.items()) for own in best]

    def _distance(self, codes: np.ndarray, low: int, high: int, number: int) -> int | None:
        """Edits, in words, between the item and the nearest stretch of codes[low:high]; None above the share allowed."""
        item, part = self.codes[number], codes[low:high]
        allowed = int(EDIT_SHARE * len(item))
        # an edit takes at most one word of the item from the part
        if np.isin(item, part).sum() < len(item) - allowed:
            return None
        distance = least_distance(item, part)
        return distance if distance <= allowed else None


def least_distance(item: np.ndarray, part: np.ndarray) -> int:
    """Edit distance from `item` to the stretch of `part` nearest to it."""
    at = np.arange(len(part) + 1)
    row = np.zeros(len(part) + 1, dtype=np.int64)
    for number, word in enumerate(item, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (part != word))
        new[0] = number
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def build_index(items: Sequence[tuple[int | None, str | None]]) -> Index:
    """An index of items: windows at several offsets of each, for every repetition of its size class.

    Items without words are left out. Windows overlap, so that edits in one leave others untouched; a
    window whose sampled steps leave the item is no entry.
    """
    known = [(item_id, words_of(text)) for item_id, text in items]
    known = sorted({(i is None, i or 0, tuple(w)) for i, w in known if w})
    names = tuple(None if none else i for none, i, _ in known)
    texts = [w for _, _, w in known]
    codes_of = tuple(word_codes(w) for w in texts)
    kinds = [class_of(len(w)) for w in texts]
    all_walks, gates, keys, owners = [], [], [], []
    for kind in sorted(set(kinds), key=lambda k: k.least):
        for walk in walks(kind):
            rows = []
            for number, words in enumerate(texts):
                if kinds[number] != kind:
                    continue
                codes = codes_of[number]
                last = len(words) - kind.window
                for offset in sorted({*range(0, last + 1, kind.apart), last}):
                    sampled = _walked(walk, codes, offset)
                    if sampled is not None:
                        rows.append((number, offset, sampled))
            if not rows:
                continue
            sampled = np.array([r[2] for r in rows], dtype=np.uint32)
            key = np.zeros(len(rows), dtype=np.uint64)
            own_gates = []
            for column in sampled.T:
                key = _mixed(key, column)
                gate = np.zeros(1 << max(16, min((16 * len(rows)).bit_length(), 24)), dtype=bool)
                gate[(key >> np.uint64(40)).astype(np.int64) & (len(gate) - 1)] = True
                own_gates.append(gate)
            order = np.argsort(key, kind="stable")
            all_walks.append(walk)
            gates.append(tuple(own_gates))
            keys.append(key[order])
            owners.append(np.array([r[:2] for r in rows], dtype=np.int64)[order])
    return Index(names, codes_of, tuple(map(len, texts)), tuple(all_walks), tuple(gates), tuple(keys), tuple(owners))


def _walked(walk: Walk, codes: np.ndarray, offset: int) -> list[int] | None:
    at, out = offset, []
    for step in range(walk.samples[-1] + 1):
        if at >= len(codes):
            return None
        if step in walk.samples:
            out.append(int(codes[at]))
        at += int(walk.step(step, codes[at : at + 1])[0])
    return out


# ---------------------------------------------------------------- Spark
def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of at most about BLOCK_ITEMS items each, one after the other."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("words")).where("words is not null")
    # copies would share one block, however many there are
    items = stored(items.distinct(), "benchmark-items")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    for number in range(blocks):
        rows = (items if blocks == 1 else items.where(block == number)).collect()
        yield build_index([(r["item"], r["words"]) for r in rows])


def hits_column(index: Index, text: Column) -> Column:
    """Array of item_id, first_word, distance, similarity for the items of the index in each text."""

    @F.pandas_udf("array<struct<item_id: long, first_word: long, distance: long, similarity: double>>")
    def compute(texts: pd.Series) -> pd.Series:
        out = []
        for found in index.search(texts.tolist()):
            rows = []
            for number, first, distance in found:
                share = 1 - distance / index.sizes[number]
                rows.append(
                    {"item_id": index.items[number], "first_word": first, "distance": distance, "similarity": share}
                )
            out.append(rows)
        return pd.Series(out, dtype=object)

    return compute(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item in it: doc_id, item_id, first_word, distance, similarity.

    An item is in a document if some stretch of it is at most a fifth of the item's words in edits away
    (words put in, left out or changed; ASCII marks and capitals aside); first_word is where its window
    begins, distance the edits to the nearest stretch. Defined cases: null and empty texts hold nothing; items without words
    are in no document; of equal items of one id one counts; null ids stay null; repeated documents
    give repeated rows; an empty table on either side gives an empty result; other columns are ignored.
    """
    found = None
    for index in item_blocks(benchmark):
        part = (
            docs.select("doc_id", F.explode(hits_column(index, F.col("text"))).alias("hit")).select("doc_id", "hit.*")
        )
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns."""
    columns, name = docs.columns, free_name(docs, "leaks_")
    for index in item_blocks(benchmark):
        docs = docs.withColumn(name, hits_column(index, F.col("text"))).where(F.size(name) == 0).select(columns)
    return docs
