"""Change files as a streaming source: a folder of JSON lines, one change envelope a line, files named in the order they were closed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, line long, value string"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URL, and the path in it; every executor opens it for itself."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def files(path: str) -> list[str]:
    """Closed change files in order. Names that start with ``.`` or ``_`` are still being written."""
    system, root = open_folder(path)
    found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith((".", "_")))


class FilePartition(InputPartition):
    def __init__(self, name: str):
        self.name = name


def lines(path: str, name: str) -> Iterator[tuple[str, int, str]]:
    system, root = open_folder(path)
    with system.open_input_stream(f"{root}/{name}") as raw:
        rest, k = b"", 0
        while chunk := raw.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if line.strip():
                    yield name, k, line.decode("utf-8", "replace")
                k += 1
        if rest.strip():
            yield name, k, rest.decode("utf-8", "replace")


class ChangeStreamReader(DataSourceStreamReader):
    """An offset is the last file taken, so a restart goes on after the last batch that was committed, and a batch that is repeated reads the same files."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.at: str | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        # a bounded step beyond what was planned last, so that one batch never takes a whole backlog
        after = self.at or ""
        ahead = [f for f in files(self.path) if f > after][: self.most]
        return {"after": ahead[-1] if ahead else after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["after"]
        return [FilePartition(f) for f in files(self.path) if start["after"] < f <= end["after"]]

    def read(self, partition: FilePartition) -> Iterator[tuple[str, int, str]]:
        return lines(self.path, partition.name)


class ChangeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in files(self.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple[str, int, str]]:
        return lines(self.path, partition.name)


class ChangeSource(DataSource):
    """``format("changes")`` with ``path`` and, for streams, ``maxFilesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChangeReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ChangeStreamReader(self.options["path"], int(self.options.get("maxFilesPerTrigger", "1000")))


def read_changes(spark: SparkSession, path: str, per_trigger: int = 1000, streaming: bool = True):
    spark.dataSource.register(ChangeSource)
    return (spark.readStream if streaming else spark.read).format("changes").option("path", path).option("maxFilesPerTrigger", per_trigger).load()
