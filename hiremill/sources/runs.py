"""Tables that grow by batches, compacted into runs.

A table is a folder with one subfolder per batch. When eight of them are closed they are merged into
a run, and eight runs of a level into one of the next, so a table of any age has a bounded number of
folders. A run is dealt into hash buckets of its key, one file each, and has Bloom filters of the keys of
every bucket; a lookup reads only the buckets whose filters say that a key may be there.

The folders' names say what they hold: a run is complete when its filters are, and what a complete run of a
higher level covers is not read, so a merge that is interrupted leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches or runs that are merged into one.
FAN = 8
#: Hash buckets of a run, by its key.
BUCKETS = 32
#: Bits of one filter, the size that bitmap_construct_agg makes; bits per key; positions of a key.
FILTER_BITS = 32_768
BITS_PER_KEY = 12
POSITIONS = 5
#: Rows of a file of a run, about.
FILE_ROWS = 5_000_000


@dataclass(frozen=True, order=True)
class Part:
    """A folder of the table: level 0 is a batch, others are runs of the batches from `first` to `last`."""

    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"batch={self.first}" if not self.level else f"run={self.level}_{self.first}_{self.last}"

    def covers(self, other: Part) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


def _runs(path: str) -> str:
    return f"{path.rstrip('/')}-runs"


def _filters(path: str) -> str:
    return f"{path.rstrip('/')}-filters"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def delete(spark: SparkSession, path: str) -> None:
    folder, files = _files(spark, path)
    files.delete(folder, True)


def parts_of(spark: SparkSession, path: str, before: int | None = None) -> list[Part]:
    """The live folders of a table; of batches, those before `before`."""
    batches = [Part(0, int(n[6:]), int(n[6:])) for n in _names(spark, path) if n.startswith("batch=")]
    done = [n for n in _names(spark, _filters(path)) if n.startswith("run=")]
    runs = []
    for name in done:
        folder, files = _files(spark, f"{_filters(path)}/{name}/_SUCCESS")
        if files.exists(folder):
            level, first, last = map(int, name[4:].split("_"))
            runs.append(Part(level, first, last))
    known = [p for p in batches + runs if before is None or p.last < before]
    return sorted(p for p in known if not any(q.covers(p) for q in runs))


def read_parts(spark: SparkSession, path: str, schema: str, parts: Iterable[Part]) -> DataFrame:
    """The rows of these folders, with the batch of each."""
    parts = list(parts)
    schema = f"{schema}, batch int"
    batches = [f"{path}/{p.name}" for p in parts if not p.level]
    runs = [f"{_runs(path)}/{p.name}" for p in parts if p.level]
    found = spark.createDataFrame([], schema)
    if batches:
        found = spark.read.schema(schema).option("basePath", path).parquet(*batches)
    if runs:
        # the bucket is a folder of the run and no column of the table
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*runs)
        found = found.unionByName(rows) if batches else rows
    return found


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(buckets)).cast("int")


def _filter_of(key: Column, filters: Column | int) -> Column:
    """Which of the filters of its bucket a key is in."""
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(filters) if isinstance(filters, int) else filters).cast("int")


def _positions(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(2 + i), key), F.lit(FILTER_BITS)) for i in range(POSITIONS)]


def _bit(bits: Column, position: Column) -> Column:
    """A bit of a bitmap; the lowest of a byte comes first."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))), F.lit(2)) == 1


def write_run(rows: DataFrame, path: str, part: Part, key: str) -> None:
    """Write a run: its buckets, in files of bounded size, then its filters, which make it complete."""
    spark = rows.sparkSession
    files = max(1, -(-rows.count() // (BUCKETS * FILE_ROWS)))
    file = F.pmod(F.xxhash64(F.lit(-1), F.col(key)), F.lit(files))
    rows.withColumn("bucket", bucket_of(F.col(key))).repartition(BUCKETS * files, "bucket", file).sortWithinPartitions(
        "bucket", key
    ).write.mode("overwrite").partitionBy("bucket").parquet(f"{_runs(path)}/{part.name}")
    stored = spark.read.schema(f"{key} string, bucket int").parquet(f"{_runs(path)}/{part.name}")
    stored = stored.select("bucket", F.col(key).alias("key"))
    most = stored.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1
    filters = max(1, -(-most * BITS_PER_KEY // FILTER_BITS))
    bits = stored.select(
        "bucket", _filter_of(F.col("key"), filters).alias("filter"), F.explode(F.array(*_positions(F.col("key")))).alias("position")
    )
    bits.groupBy("bucket", "filter").agg(F.bitmap_construct_agg("position").alias("bits")).withColumn(
        "filters", F.lit(filters)
    ).write.mode("overwrite").parquet(f"{_filters(path)}/{part.name}")


def compact(spark: SparkSession, path: str, schema: str, key: str, before: int) -> None:
    """Merge what is closed: batches before `before`, and runs of one level, where there are eight of them.

    `before` is the batch at work: it may run again, so it and its like are left alone.
    """
    level = 0
    while True:
        live = [p for p in parts_of(spark, path, before) if p.level == level]
        if len(live) < FAN:
            if not any(p.level > level for p in parts_of(spark, path, before)):
                break
            level += 1
            continue
        merged = Part(level + 1, min(p.first for p in live), max(p.last for p in live))
        write_run(read_parts(spark, path, schema, live), path, merged, key)
    remove_covered(spark, path)


def remove_covered(spark: SparkSession, path: str) -> None:
    """Delete the folders that a complete run stands for."""
    live = {p.name for p in parts_of(spark, path)}
    complete = [p for p in parts_of(spark, path) if p.level]
    for name in _names(spark, path):
        if name.startswith("batch=") and name not in live:
            number = int(name[6:])
            if any(p.covers(Part(0, number, number)) for p in complete):
                delete(spark, f"{path}/{name}")
    for name in _names(spark, _filters(path)):
        if name.startswith("run=") and name not in live:
            level, first, last = map(int, name[4:].split("_"))
            if any(p.covers(Part(level, first, last)) for p in complete):
                # without its filters a run is not complete, so they go first
                delete(spark, f"{_filters(path)}/{name}")
                delete(spark, f"{_runs(path)}/{name}")


def bucket_folders(keys: DataFrame, key: str, path: str, runs: Iterable[Part]) -> list[str]:
    """The folders of the buckets that may hold one of the keys; at most one for each bucket of each run."""
    runs = [p for p in runs if p.level]
    if not runs:
        return []
    spark = keys.sparkSession
    filters = spark.read.parquet(*[f"{_filters(path)}/{p.name}" for p in runs]).withColumn(
        "run", F.element_at(F.split(F.input_file_name(), "/"), -2)
    )
    sizes = filters.select("run", "filters").distinct().collect()
    if not sizes:
        return []
    each = F.array(*[F.struct(F.lit(r["run"]).alias("run"), F.lit(r["filters"]).alias("filters")) for r in sizes])
    asked = (
        keys.select(F.col(key).alias("key"), F.explode(each).alias("in_"))
        .select("key", "in_.run", bucket_of(F.col("key")).alias("bucket"), _filter_of(F.col("key"), F.col("in_.filters")).alias("filter"))
    )
    possible = F.lit(True)
    for position in _positions(F.col("key")):
        possible = possible & _bit(F.col("bits"), position)
    met = asked.join(filters.drop("filters"), ["run", "bucket", "filter"]).where(possible)
    hits = met.select("run", "bucket").distinct().collect()
    return sorted(f"{_runs(path)}/{r['run']}/bucket={r['bucket']}" for r in hits)


def keys_met(keys: DataFrame, key: str, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Those of the keys that the table holds: recent batches are scanned, of runs the buckets in question."""
    spark = keys.sparkSession
    live = parts_of(spark, path, before)
    rows = read_parts(spark, path, schema, [p for p in live if not p.level]).select(key)
    folders = bucket_folders(keys, key, path, live)
    if folders:
        rows = rows.unionByName(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders).select(key))
    return rows.join(keys.select(key), key, "left_semi").distinct()
