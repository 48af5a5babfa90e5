"""Token ids in binary files of fixed bit width, with block offsets for random access."""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from hiremill.llm.common import once, stored
from hiremill.session import work_folder

#: File layout, little-endian: HEADER; packed blocks; per block its byte offset (uint64); per document
#: its first id in the file, its number of ids, its document id and whether it has one (8 bytes each);
#: FOOTER, which says where those lie.
MAGIC = b"TIDS"
HEADER = "<4sBBHI"
FOOTER = "<QQQQ"
VERSION = 1
#: Ids of a block. A multiple of 8, so that blocks of every width end at a byte.
BLOCK_IDS = 1 << 14
END_ID = 2
#: Bytes of text that go to one file, about.
FILE_TEXT_BYTES = 64 << 20
#: Words of which a worker remembers the ids (those of small ASCII letters lie in Arrow arrays, others in a dictionary),
#: and bytes of text whose words it takes together.
LETTER_WORDS = 1_000_000
CACHE_WORDS = 50_000
BATCH_TEXT_BYTES = 4 << 20
MARKS = ".,;:!?"
IDS = pa.list_(pa.uint32())
#: Ids a reader takes together.
READ_IDS = 1 << 21


def bit_width(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids one after the other in `width` bits each, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * width, bitorder="little")
    padded = np.zeros((count, 32), dtype=np.uint8)
    padded[:, :width] = bits.reshape(count, width)
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


# ---------------------------------------------------------------- encoding
class WordEncoder:
    """A tokenizer that drops white space, applied to the distinct words of a batch.

    Words end at the six ASCII spaces, which separate tokens whatever stands around them, so the ids
    of a text are those of its words in a row. Words of Latin letters go to the model directly, in the
    byte alphabet it is defined on; all others, marks of special tokens included, pass through the
    whole tokenizer. A tokenizer of another make gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocabulary = 1 + max(
            max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0), END_ID
        )
        self.cache: dict[str, list[int]] = {}
        self.letters, self.letter_ids = pa.array([], pa.large_string()), pa.array([], IDS)
        self.by_word = _drops_spaces(json.loads(self.tokenizer.to_str())) and self._agrees()

    def _agrees(self) -> bool:
        sample = "A small Test, of words and 12 numbers; d\u00e9j\u00e0 vu."
        whole = self.tokenizer.encode(sample, add_special_tokens=False).ids
        return whole == [i for w in sample.split(" ") for i in self._split(w)]

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's ended by `end_id`, and their numbers."""
        texts = texts.fill_null("")
        if not self.by_word:
            found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            lists = [np.array([*e.ids, end_id], dtype=np.uint32) for e in found]
            counts = np.array([len(x) for x in lists], dtype=np.int64)
            return np.concatenate(lists or [np.empty(0, dtype=np.uint32)]), counts
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        in_text = np.diff(words.offsets.to_numpy())
        del words
        lists = self._word_lists(coded.dictionary)
        # the end id stands as one more word at the end of every text
        lists = pa.concat_arrays([lists, pa.array([[end_id]], lists.type)])
        sizes = pc.list_value_length(lists).to_numpy()
        before = np.cumsum(in_text)
        order = np.insert(coded.indices.to_numpy(), before, len(lists) - 1)
        del coded
        counts = np.add.reduceat(sizes[order], before + np.arange(len(before)) - in_text, dtype=np.int64) if len(before) else in_text
        return lists.take(pa.array(order)).flatten().to_numpy(), counts

    def _word_lists(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words. Words of ASCII letters, with marks after them or none, share those of the bare word."""
        bare = pc.utf8_rtrim(words, MARKS)
        longest = pc.binary_length(bare)
        marks = pc.subtract(pc.binary_length(words), longest).to_numpy()
        plain = pc.and_(pc.ascii_is_alpha(bare), pc.less(longest, 64)).to_numpy(zero_copy_only=False) & (marks <= 1)
        places = np.flatnonzero(plain)
        low = pc.ascii_lower(bare.take(pa.array(places))).dictionary_encode()
        ends = pc.utf8_slice_codeunits(words.take(pa.array(places)), -1).dictionary_encode()
        tails = ends.dictionary.to_pylist()
        known = pa.array([*(self.word_ids(t) if t in MARKS else [] for t in tails), []], IDS)
        after = np.where(marks[places] > 0, ends.indices.to_numpy(), len(tails))
        found = self._letter_lists(low.dictionary).take(low.indices)
        # a list of two parts for each word, then one of their ids
        two = pa.concat_arrays([found, known.take(pa.array(after))])
        pairs = np.arange(2 * len(places)).reshape(2, -1).T.ravel()
        two = two.take(pa.array(pairs))
        found = pa.ListArray.from_arrays(two.offsets.take(pa.array(np.arange(0, len(two) + 1, 2))), two.values)
        rest = np.flatnonzero(~plain)
        others = pa.array(list(map(self.word_ids, words.take(pa.array(rest)).to_pylist())), IDS)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        back = np.empty(len(words), dtype=np.int64)
        back[places] = np.arange(len(places))
        back[rest] = np.arange(len(places), len(words))
        return pa.concat_arrays([found, others]).take(pa.array(back))

    def _letter_lists(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words of small ASCII letters, those of words met before from a table of Arrow arrays."""
        at = pc.index_in(words, self.letters)
        new = words.filter(at.is_null())
        tokenize = self.tokenizer.model.tokenize
        lists = pa.array([[token.id for token in tokenize(word)] for word in new.to_pylist()], IDS)
        joined = pa.concat_arrays([self.letter_ids, lists])
        order = at.to_numpy(zero_copy_only=False).astype(np.float64)
        order[np.isnan(order)] = len(self.letters) + np.arange(len(new))
        out = joined.take(pa.array(order.astype(np.int64)))
        if len(joined) > LETTER_WORDS:
            self.letters, self.letter_ids = new[:LETTER_WORDS], lists[:LETTER_WORDS]
        else:
            self.letters, self.letter_ids = pa.concat_arrays([self.letters, new]), joined
        return out

    def word_ids(self, word: str) -> list[int]:
        known = self.cache.get(word)
        if known is None:
            known = self._split(word)
            if len(word) < 64:
                self.cache[word] = known
        return known

    def _split(self, word: str) -> list[int]:
        """A word of letters with marks after it has the ids of the bare word, then those of the marks."""
        bare = word.rstrip(MARKS)
        if len(bare) == len(word) or not _plain(bare):
            return self._whole(word) if word else []
        low = bare.lower()
        marks = word[len(bare) :]
        known = self.cache.get(low)
        if known is None:
            known = self._whole(low)
            if len(low) < 64:
                self.cache[low] = known
        tail = self.cache.get(marks)
        if tail is None:
            tail = self.cache[marks] = self._whole(marks)
        return known + tail

    def _whole(self, word: str) -> list[int]:
        if len(word) < 64 and _plain(word):
            letters = unicodedata.normalize("NFC", word).lower().encode().decode("latin-1").translate(BYTE_LETTERS)
            return [token.id for token in self.tokenizer.model.tokenize(letters)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids


def _plain(word: str) -> bool:
    """Latin letters alone, also in lower case: then every step before the model is known exactly."""
    return word.isalpha() and max(word) < "\u0250" and word.lower().isalpha()


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _drops_spaces(layout: dict) -> bool:
    """Whether the tokenizer's parts are those for which a text may be encoded word by word."""
    steps = [s.get("type") for s in (layout.get("normalizer") or {}).get("normalizers", [])]
    first = ((layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and "[^\\s\\p{L}\\p{N}]" in json.dumps(first.get("pattern")).replace("\\\\", "\\")
        and (layout.get("model") or {}).get("end_of_word_suffix") == "</w>"
        and not (layout.get("model") or {}).get("dropout")
        and "ByteLevel" in json.dumps(layout["pre_tokenizer"])
    )


def encoder(path: str) -> WordEncoder:
    return once(("encoder", path), lambda: WordEncoder(path))


# ---------------------------------------------------------------- files
def write_file(
    target: str, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], width: int
) -> tuple[int, int]:
    """Write one file from batches of (document ids, which of them are known, ids, numbers of ids).

    Returns the numbers of documents and ids. The file appears under its name once it is whole.
    """
    fs, path = pyarrow.fs.FileSystem.from_uri(target)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    offsets: list[int] = []
    table: list[np.ndarray] = []
    total = 0
    rest = np.empty(0, dtype=np.uint32)
    with fs.open_output_stream(part) as out:
        out.write(struct.pack(HEADER, MAGIC, VERSION, width, 0, BLOCK_IDS))
        at = struct.calcsize(HEADER)

        def put(ids: np.ndarray) -> None:
            nonlocal at
            for start in range(0, len(ids), BLOCK_IDS):
                block = pack(ids[start : start + BLOCK_IDS], width)
                offsets.append(at)
                out.write(block)
                at += len(block)

        for names, known, ids, counts in batches:
            firsts = total + np.cumsum(counts) - counts
            table.append(np.stack([firsts, counts, np.where(known, names, 0), known], axis=1).astype("<i8"))
            total += len(ids)
            ids = np.concatenate([rest, ids])
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            put(ids[:whole])
            rest = ids[whole:]
        put(rest)
        rows = np.concatenate(table) if table else np.empty((0, 4), dtype="<i8")
        out.write(np.array(offsets, dtype="<u8").tobytes())
        out.write(rows.tobytes())
        out.write(struct.pack(FOOTER, at, len(offsets), len(rows), total))
    fs.move(part, path)
    return len(rows), total


class TokenFile:
    """Random access to a file: the ids of a document are read from the blocks that hold them."""

    def __init__(self, source: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(source)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = struct.calcsize(FOOTER)
        magic, _, self.width, _, self.block = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if magic != MAGIC:
            raise ValueError(f"{source} is no token file")
        where, blocks, documents, self.total = struct.unpack(FOOTER, self.file.read_at(foot, size - foot))
        index = self.file.read_at(size - foot - where, where)
        self.offsets = np.frombuffer(index, dtype="<u8", count=blocks).astype(np.int64)
        self.offsets = np.append(self.offsets, where)
        table = np.frombuffer(index, dtype="<i8", offset=8 * blocks).reshape(documents, 4)
        self.documents, self.names, self.named = table[:, :2], table[:, 2], table[:, 3].astype(bool)

    def ids(self, first: int, count: int) -> np.ndarray:
        if not count:
            return np.empty(0, dtype=np.uint32)
        low, high = first // self.block, (first + count - 1) // self.block
        begin, end = int(self.offsets[low]), int(self.offsets[high + 1])
        held = min(self.total, (high + 1) * self.block) - low * self.block
        ids = unpack(self.file.read_at(end - begin, begin), self.width, held)
        return ids[first - low * self.block :][:count]

    def document(self, number: int) -> np.ndarray:
        first, count = self.documents[number]
        return self.ids(int(first), int(count))

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID
) -> DataFrame:
    """Write all documents in ascending id order; a stored table with a row per file.

    Columns: file (a number in that order), path, documents, tokens, start (ids in the files before).
    Files are ranges of ids, so their order is that of the ids. A task writes its file under a name of
    its own and then moves it, so a repeated task replaces the file with the same content.
    """
    target = _uri(folder)
    pyarrow.fs.FileSystem.from_uri(target)[0].create_dir(pyarrow.fs.FileSystem.from_uri(target)[1])
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(2 * cores, -(-size // FILE_TEXT_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        number = TaskContext.get().partitionId()
        path = f"{target}/part-{number:06d}.tids"

        def encoded() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
                for low, high in _runs(sizes, BATCH_TEXT_BYTES):
                    names = batch.column("doc_id")[low:high]
                    ids, counts = known.encode_batch(batch.column("text")[low:high], end_id)
                    yield names.fill_null(0).to_numpy(), names.is_valid().to_numpy(zero_copy_only=False), ids, counts

        written, tokens = write_file(path, encoded(), bit_width(known.vocabulary))
        yield pa.RecordBatch.from_pydict(
            {"file": pa.array([number], pa.int32()), "path": [path], "documents": [written], "tokens": [tokens]}
        )

    # rows of one id have an order of their own, so that a repeated task writes the same file
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = own.repartitionByRange(int(files), *order).sortWithinPartitions(*order)
    parts = stored(placed.mapInArrow(write, "file int, path string, documents long, tokens long"), "token-files")
    before = F.sum("tokens").over(_by_file()) - F.col("tokens")
    return stored(parts.withColumn("start", before.cast("long")), "token-index")


def _by_file():
    # one row per file of FILE_TEXT_BYTES: a few MB of rows for 100 TB of text
    return Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def read_token_files(index: DataFrame) -> DataFrame:
    """From the files, per document: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with TokenFile(row.path) as file:
                    for low, high in _runs(file.documents[:, 1], READ_IDS):
                        firsts, counts = file.documents[low:high].T
                        ids = file.ids(int(firsts[0]), int(counts.sum())).astype("<u4")
                        data = memoryview(ids.tobytes())
                        begins = ((firsts - firsts[0]) * 4).tolist()
                        crcs = [zlib.crc32(data[b : b + 4 * n]) for b, n in zip(begins, counts.tolist(), strict=True)]
                        names = pd.Series(file.names[low:high]).astype("Int64").where(file.named[low:high])
                        yield pd.DataFrame(
                            {"doc_id": names, "start": firsts + row.start, "n_tokens": counts, "ids_crc32": crcs}
                        )

    tasks = max(1, index.sparkSession.sparkContext.defaultParallelism)
    return index.repartition(tasks, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents whose counts sum up to about `most`, or of one document."""
    before = np.concatenate([[0], np.cumsum(counts)])
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(before, before[low] + most, side="right")) - 1)
        yield low, high
        low = high


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents to token files in the shared folder, read those back: doc_id, start, n_tokens, ids_crc32.

    Each document's ids end with id 2. Defined cases: null and empty texts have that id alone; null
    ids come first; rows of one id stand next to each other, by a hash of their text; repeated rows
    stay repeated; an empty table gives files without documents and an empty result; other columns are
    ignored.
    """
    return read_token_files(write_token_files(docs, tokenizer, work_folder(docs.sparkSession, "tids")))
