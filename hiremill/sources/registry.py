"""Source plug-ins: a name and a reader ``(spark, path) -> DataFrame``."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiremill.operators.sets import union_sources
from hiremill.session import work_folder

Reader = Callable[[SparkSession, str], DataFrame]
logger = logging.getLogger(__name__)


class SourceRegistry:
    """Registered sources in the order they are read; the order is their rank."""

    def __init__(self) -> None:
        self._readers: dict[str, Reader] = {}

    def register(self, name: str, reader: Reader) -> None:
        self._readers[name] = reader

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self._readers)

    def read(self, spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
        """All sources with a path as one table. A source that cannot be read adds nothing and stops nothing."""
        frames: list[tuple[str, DataFrame | None]] = []
        for name, reader in self._readers.items():
            if name not in paths:
                continue
            try:
                frames.append((name, reader(spark, paths[name])))
            except (PySparkException, OSError) as error:
                logger.warning("source %s could not be read: %s", name, type(error).__name__)
                frames.append((name, None))
        return union_sources(frames)

    def collect(self, spark: SparkSession, paths: Mapping[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
        """(rows, errors): what every source with a path gave, stored, and the sources that failed.

        A source is read to its end, so one that fails while its rows are read is told as well and stops
        nothing; none of its rows count. rows: the columns of the schema (null where a source lacks one),
        source_rank and source; empty if no source could be read. errors: source, path, error.
        """
        wanted = spark.createDataFrame([], schema)
        found: list[tuple[str, DataFrame | None]] = []
        errors: list[tuple[str, str, str]] = []
        for name, reader in self._readers.items():
            if name not in paths:
                continue
            try:
                frame = reader(spark, paths[name])
                folder = work_folder(spark, f"source-{name}")
                missing = {f.name: F.lit(None).cast(f.dataType) for f in wanted.schema.fields if f.name not in frame.columns}
                frame.withColumns(missing).select(wanted.columns).write.parquet(folder)
                found.append((name, spark.read.schema(wanted.schema).parquet(folder)))
            except (PySparkException, Py4JError, OSError) as error:
                logger.warning("source %s could not be read: %s", name, type(error).__name__)
                found.append((name, None))
                errors.append((name, paths[name], type(error).__name__))
        if all(frame is None for _, frame in found):
            rows = wanted.withColumn("source_rank", F.lit(0)).withColumn("source", F.lit(""))
        else:
            rows = union_sources(found)
        return rows, spark.createDataFrame(errors, "source string, path string, error string")
