"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiremill.session import work_folder

#: Words are separated by the six ASCII spaces only.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of an Arrow batch that a worker holds as Python strings at a time.
SLICE_ROWS = 256
#: Bits of the filter that rows are held against before they meet a table of keys.
FILTER_BITS = 1 << 24


def once(key: Hashable, make: Callable[[], Any]) -> Any:
    """A value made once in each Python process.

    Functions travel to the executors by value, so the globals of this package live as long as a task;
    what a reused worker may keep for its next task is held in a module of its own.
    """
    held = sys.modules.setdefault("_hiremill_once", types.ModuleType("_hiremill_once")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def text_slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in lists of SLICE_ROWS."""
    for at in range(0, len(texts), SLICE_ROWS):
        yield texts.slice(at, SLICE_ROWS).to_pylist()


def stored(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows as a table in the cluster's shared folder; a file holds one value of the columns `by`.

    It cuts the lineage, so that a lost executor costs the tasks that read it and not the work
    before it, and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path, partitionBy=list(by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at_ = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at_)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sifted(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose `column` may be among the keys, and those whose `column` certainly is not.

    `column` is a hash, never null, in both tables. One bit stands for the keys of one remainder, so a row is
    told where it lies, and of a large table only the rows of few keys move to be joined with them.
    """
    word, bits = free_name(df, "filter_word_"), free_name(df, "filter_bits_")
    place = F.pmod(F.col(column), F.lit(FILTER_BITS)).cast("int")
    words = stored(
        keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias(word))
        .agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias(bits)),
        "filter",
    )
    tested = df.join(F.broadcast(words), F.shiftright(place, 6) == words[word], "left")
    held = F.coalesce(F.getbit(F.col(bits), place % F.lit(64)) == 1, F.lit(False))
    return tested.where(held).select(df.columns), tested.where(~held).select(df.columns)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet."""
    while wanted.lower() in (c.lower() for c in df.columns):
        wanted += "_"
    return wanted


def unit_hash(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def fold(doc_id: Column, folds: int = 4) -> Column:
    """Checksum of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a row without an id never is."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def bounded_sample(
    df: DataFrame, label: str, rows: int, key: Sequence[str], seed: int, most: dict[object, int] | None = None
) -> DataFrame:
    """About `rows` rows for each value of `label` (or `most[value]`), chosen by a hash of `key`.

    The hash cut needs one count per label and no shuffle of the texts. Repeated rows share their
    hash, so a final limit of twice the sum bounds what the driver receives.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {value: (most or {}).get(value, rows) for value in counts}
    if not counts:
        return df.limit(0)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(wanted[value] / n)).otherwise(share)
    return df.where(unit_hash(*[F.col(c) for c in key], seed=seed) < share).limit(2 * sum(wanted.values()))
