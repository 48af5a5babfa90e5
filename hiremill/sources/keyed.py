"""Ledgers that change: a table in hash buckets of its key, of which a change rewrites only those it meets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill.session import work_folder

BUCKETS = 64


def with_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    """Replace the buckets of these rows and no others."""
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_keyed(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new table. The number of buckets belongs to it: later changes must name the same."""
    _write(with_bucket(rows, key, buckets), path)


def read_keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(path).drop("bucket")


def change_keyed(
    spark: SparkSession,
    path: str,
    schema: str,
    key: str,
    changes: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> list[int]:
    """Apply changes with `merge(rows, changes)`; the buckets that were written anew.

    Only the buckets of the changed keys are read and replaced; the others keep their files. `merge` gives the rows
    of the keys it is given, all columns of the schema. The new buckets are written aside first, so that a run that
    fails can be repeated: before the replacement nothing has changed, and the same changes give the same rows
    after it, as long as `merge` takes the last version of a row.
    """
    folder = work_folder(spark, "changes")
    with_bucket(changes, key, buckets).write.parquet(f"{folder}/changes")
    stored = spark.read.schema(f"{_types(changes)}, bucket int").parquet(f"{folder}/changes")
    # at most one row for each bucket reaches the driver
    touched = sorted(r["bucket"] for r in stored.select("bucket").distinct().collect())
    current = spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    merged = with_bucket(merge(current, stored.drop("bucket")), key, buckets)
    merged.write.parquet(f"{folder}/merged")
    _write(spark.read.schema(f"{schema}, bucket int").parquet(f"{folder}/merged"), path)
    return touched


def _types(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
