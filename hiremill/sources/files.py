"""Folders of files of which some cannot be read: those cost their own rows and are told."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JError

ERRORS = "file string, error string, records bigint"
MALFORMED = "malformed record"
_CORRUPT = "_corrupt"


def read_files(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of all files below a folder.

    rows: the columns of the schema and ``file``. errors: file, error, records; an unreadable file has one row with the
    class of its error and no records, a JSON file with malformed lines one with their number. A file that was
    written without rows is no error, nor is one of no bytes, which Spark never opens. The errors are found by a scan of the file names alone; only files that gave
    no row are opened again, one by one.
    """
    scan = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    if format == "json":
        # lines are parsed as a column, so that malformed ones can be asked for alone
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        lines = scan.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
        found = lines.select(F.from_json("value", f"{schema}, {_CORRUPT} string", options).alias("_row"), "file").select("_row.*", "file")
    else:
        found = scan.format(format).schema(schema).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    malformed = None
    rows = found
    if format == "json":
        malformed = (
            found.where(F.col(_CORRUPT).isNotNull()).groupBy("file")
            .agg(F.count(F.lit(1)).alias("records")).select("file", F.lit(MALFORMED).alias("error"), "records")
        )
        rows = found.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    given = found.select("file").distinct()
    # the driver lists these names for every scan of the folder
    silent = listed.join(given, _plain(F.col("path")) == _plain(F.col("file")), "left_anti").collect()
    broken = [(r["path"], error, 0) for r in silent if (error := _error(spark, r["path"], schema, format))]
    errors = spark.createDataFrame(broken, ERRORS)
    return rows, errors if malformed is None else errors.unionByName(malformed)


def _plain(path):
    """File names as both scans spell them."""
    return F.regexp_replace(path, "^([a-z]+):/+", "$1:/")


def _error(spark: SparkSession, path: str, schema: str, format: str) -> str | None:
    """Why one file cannot be read; None for a readable one."""
    try:
        spark.read.format(format).schema(schema).load(path).write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JError) as error:
        return type(error).__name__
    return None
