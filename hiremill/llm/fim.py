"""Fill-in-middle transformation over piece tables.

A document is a list of descriptors over two buffers that never change: its text and the sentinels.
Cutting splits descriptors, an arrangement permutes them, the inverse permutation restores the text;
digests are taken descriptor by descriptor, so no rearranged copy of a text is made for them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sentinels of prefix, suffix and middle, one after the other in their own buffer.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT_BUFFER, SENTINEL_BUFFER = 0, 1
LINE = re.compile(r"[^\n]*\n|[^\n]+")
#: Percent of the texts that are rearranged, and of those the percent with the suffix first.
RATE = 100
SPM_RATE = 50
SEED = 7
#: Characters of a descriptor that are encoded at a time for a digest.
RUN = 1 << 20


class Piece(NamedTuple):
    """A stretch of a buffer, in code points."""

    buffer: int
    start: int
    length: int


#: Where each piece of the cut text (0 prefix, 1 middle, 2 suffix) and each sentinel stands in the output.
ARRANGEMENTS = {
    "psm": (("sentinel", PREFIX), ("piece", 0), ("sentinel", SUFFIX), ("piece", 2), ("sentinel", MIDDLE), ("piece", 1)),
    "spm": (("sentinel", SUFFIX), ("piece", 2), ("sentinel", PREFIX), ("piece", 0), ("sentinel", MIDDLE), ("piece", 1)),
}


@dataclass(frozen=True)
class PieceTable:
    """Descriptors over a text and the sentinels."""

    text: str
    pieces: tuple[Piece, ...]

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls(text, (Piece(TEXT_BUFFER, 0, len(text)),))

    def cut(self, places: Sequence[int]) -> PieceTable:
        """The table with a border at each of the ascending places, counted from the start of its contents."""
        out: list[Piece] = []
        wanted = list(places)
        at = 0
        for piece in self.pieces:
            start, left = piece.start, piece.length
            while wanted and wanted[0] <= at + left:
                own = wanted.pop(0) - at
                out.append(Piece(piece.buffer, start, own))
                start, left, at = start + own, left - own, at + own
            out.append(Piece(piece.buffer, start, left))
            at += left
        return PieceTable(self.text, tuple(out))

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix in the order of the form, behind their sentinels."""
        return PieceTable(
            self.text,
            tuple(
                self.pieces[what] if kind == "piece" else Piece(SENTINEL_BUFFER, SENTINELS.index(what), len(what))
                for kind, what in ARRANGEMENTS[form]
            ),
        )

    def restored(self, form: str) -> PieceTable:
        """The inverse of `arranged`: the pieces that are no sentinels, in their first order."""
        order = [what if kind == "piece" else None for kind, what in ARRANGEMENTS[form]]
        return PieceTable(self.text, tuple(self.pieces[order.index(number)] for number in range(3)))

    def runs(self) -> Iterator[str]:
        """The contents in bounded runs."""
        for buffer, start, length in self.pieces:
            content = self.text if buffer == TEXT_BUFFER else SENTINELS
            for at in range(start, start + length, RUN):
                yield content[at : min(at + RUN, start + length)]

    def digest(self) -> str:
        found = hashlib.sha256()
        for run in self.runs():
            found.update(run.encode("utf-8", "surrogatepass"))
        return found.hexdigest()

    def content(self) -> str:
        return "".join(self.runs())


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """The first four 8-digit groups of the digest of seed and id; a missing id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: str | None, doc_id: object, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, PieceTable]:
    """(lines, form, table of the output). A plain text keeps its one descriptor."""
    text = text or ""
    ends = [m.end() for m in LINE.finditer(text)]
    n = len(ends)
    one, two, three, four = draws(doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
        return n, "plain", PieceTable.of(text)
    borders = [0, *ends]
    places = [borders[i] for i in sorted((one % (n + 1), two % (n + 1)))]
    form = "spm" if four % 100 < spm_rate else "psm"
    return n, form, PieceTable.of(text).cut(places).arranged(form)


def restore(output: str | None, form: str) -> PieceTable:
    """The text an output of this form was made of, as a table over the output."""
    table = PieceTable.of(output or "")
    if form == "plain":
        return table
    places, at = [], 0
    for kind, what in ARRANGEMENTS[form]:
        if kind == "sentinel":
            at = table.text.index(what, at)
            places += [at, at + len(what)]
    # the first border is the start of the output, before which an empty piece stands
    cut = table.cut(places)
    return PieceTable(table.text, cut.pieces[1:]).restored(form)


def with_fim(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", name: str = "fim", rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """The documents, all columns, with a struct `name`: lines, form, pieces and output.

    `pieces` are the descriptors (buffer 0 the text, 1 the sentinels; start and length in code points).
    A column called `name` is replaced. Defined cases: null and empty texts are plain, with an empty
    output and one descriptor of length 0; a null id draws like an empty one; repeated rows stay
    repeated and draw alike; texts are taken whole; an empty table gives an empty result.
    """

    @F.pandas_udf(
        "lines long, form string, pieces array<struct<buffer: int, start: long, length: long>>, output string"
    )
    def compute(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = []
        for one, own in zip(texts, ids, strict=True):
            n, form, table = transform(one, own, rate, spm_rate)
            out.append((n, form, [p._asdict() for p in table.pieces], table.content()))
        return pd.DataFrame(out, columns=["lines", "form", "pieces", "output"])

    return docs.withColumn(name, compute(F.col(text), F.col(doc_id).cast("string")))


def with_restored(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """The rows with the text that each output was made of."""

    @F.pandas_udf("string")
    def compute(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f).content() for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return rows.withColumn(name, compute(F.col(output), F.col(form)))


def transform_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    The restored text is read back from the output, not from the input. Defined cases as in `with_fim`;
    a plain text has null for both lengths; other columns are ignored.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, number, text in zip(batch["doc_id"], batch["id_"], batch["text"], strict=True):
                n, form, table = transform(text, number)
                lengths = (None, None)
                if form != "plain":
                    own_pieces = table.restored(form).pieces
                    lengths = (own_pieces[0].length, own_pieces[1].length)
                back = restore(table.content(), form)
                out.append((own, n, form, *lengths, table.digest(), back.digest()))
            frame = pd.DataFrame(
                out, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
            )
            yield frame.astype({"doc_id": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").cast("string").alias("id_"), F.col("text")
    )
    return rows.mapInPandas(
        digest,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    )


#: The same in SQL: the draws, the lines and the three parts of each text.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM docs),
drawn AS (
  SELECT *, len(lines) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(lines[1:low], ''), '') AS p, coalesce(array_to_string(lines[low + 1:high], ''), '') AS m,
         coalesce(array_to_string(lines[high + 1:n], ''), '') AS s FROM formed),
arranged AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 1)
                || regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 3) || regexp_extract(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', 2)
              ELSE regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 2)
                || regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 3) || regexp_extract(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', 1)
              END) AS restored_sha256
FROM arranged
"""
