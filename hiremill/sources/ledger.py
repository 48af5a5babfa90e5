"""The published ledger as Parquet: append-only, a folder per batch, old batches merged into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill import schemas
from hiremill.functions.identity import valid_fingerprint
from hiremill.operators.dedupe import new_posts
from hiremill.sources import runs

LEDGER_COLUMNS = ("fingerprint", "title", "source", "url")


def rows_to_publish(posts: DataFrame, ledger: DataFrame, order: list[Column]) -> DataFrame:
    """Ledger rows that are inserted for these posts; fingerprints already there are refused."""
    return new_posts(posts, ledger, order).select(*LEDGER_COLUMNS)


def lookup_published_url(requests: DataFrame, ledger: DataFrame, vacancy: str = "vacancy_id") -> DataFrame:
    """Requests with the URL of the post they name; null for malformed and unknown ids."""
    posts = ledger.select(F.col("fingerprint").alias("_id"), F.col("url").alias("published_url"))
    asked = F.when(valid_fingerprint(F.col(vacancy)), F.col(vacancy))
    return requests.join(posts, asked == F.col("_id"), "left").drop("_id")


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch. A retried batch replaces its own folder and nothing else."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(
    spark: SparkSession, path: str, schema: str = schemas.PUBLISHED, *, before: int | None = None
) -> DataFrame:
    """All rows of a table of batches and runs, or those before a batch; a table without batches is empty."""
    rows = runs.read_parts(spark, path, schema, runs.parts_of(spark, path, before))
    return rows if before is None else rows.filter(F.col("batch") < before)


def schema_of(spark: SparkSession, path: str) -> str:
    """The columns of a table of batches, from its newest batch."""
    last = max(p for p in runs.parts_of(spark, path) if not p.level)
    return ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{last.name}").schema.fields
    )


def evolve_ledger(*versions: DataFrame) -> DataFrame:
    """Tables of several versions as one; columns a version lacks are null."""
    first, *rest = versions
    for version in rest:
        first = first.unionByName(version, allowMissingColumns=True)
    return first
