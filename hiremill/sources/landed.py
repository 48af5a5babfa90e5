"""Landed payloads as a Spark data source, for batch and for streams.

``spark.read.format("landed")`` and ``spark.readStream.format("landed")`` read a folder of text files, one payload
a line. Every file is a partition. A stream's offset is the name of the last file it has read, so files must
land under ascending names; a batch takes all that have landed since.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position bigint, payload string"
_ARROW = pa.schema([("file", pa.string()), ("position", pa.int64()), ("payload", pa.string())])
LINES_PER_BATCH = 4096


class LandedFile(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


def _root(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def names(path: str) -> list[str]:
    """The files of the folder, below it, in ascending order; hidden ones and marks are left out."""
    system, root = _root(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = (f.path[len(root) :].lstrip("/") for f in found if f.is_file)
    return sorted(f for f in files if not any(part.startswith(("_", ".")) for part in f.split("/")))


def read_lines(path: str, name: str) -> Iterator[pa.RecordBatch]:
    """The lines of one file in bounded batches; their number in the file is their position."""
    system, root = _root(path)
    position, lines, rest = 0, [], b""

    def batch() -> pa.RecordBatch:
        start = position - len(lines)
        payloads = [line.decode("utf-8", "replace") for line in lines]
        columns = [[name] * len(lines), list(range(start, position)), payloads]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    with system.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as stream:
        while chunk := stream.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                lines.append(line)
                position += 1
                if len(lines) == LINES_PER_BATCH:
                    yield batch()
                    lines = []
    if rest:
        lines.append(rest)
        position += 1
    if lines:
        yield batch()


class LandedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[LandedFile]:
        return [LandedFile(n) for n in names(self.path)] or [LandedFile("")]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from read_lines(self.path, partition.name)


class LandedStreamReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max(names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        return [LandedFile(n) for n in names(self.path) if start["file"] < n <= end["file"]]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        yield from read_lines(self.path, partition.name)


class LandedSource(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])

    def streamReader(self, schema) -> LandedStreamReader:  # noqa: N802
        return LandedStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedSource)
