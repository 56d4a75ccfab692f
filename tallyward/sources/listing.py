"""File listings as a data source: folders are listed by tasks, and no file is opened."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "path string, name string, parent string, size_bytes long, last_modified timestamp"


class Folder(InputPartition):
    """A folder to list, alone or with everything below it."""

    def __init__(self, path: str, below: bool) -> None:
        super().__init__((path, below))
        self.path, self.below = path, below


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ListingReader(DataSourceReader):
    """The driver lists the first levels of folders only, until there are enough of them; tasks list what is below."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.folders = int(options.get("folders", 64))

    def partitions(self) -> list[InputPartition]:
        files, root = _opened(self.path)
        parts, level = [], [root]
        while level and len(level) < self.folders:
            parts += [Folder(p, False) for p in level]
            found = [files.get_file_info(pafs.FileSelector(p)) for p in level]
            level = [i.path for infos in found for i in infos if i.type == pafs.FileType.Directory]
        return [*parts, *[Folder(p, True) for p in level]] or [Folder(root, True)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, _ = _opened(self.path)
        found = [i for i in files.get_file_info(pafs.FileSelector(partition.path, recursive=partition.below)) if i.type == pafs.FileType.File]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i.path for i in found], pa.string()), pa.array([i.base_name for i in found], pa.string()),
                pa.array([i.path.rpartition("/")[0] for i in found], pa.string()), pa.array([i.size for i in found], pa.int64()),
                pa.array([i.mtime for i in found], pa.timestamp("us", "UTC")),
            ],
            names=["path", "name", "parent", "size_bytes", "last_modified"],
        )


class FileListing(DataSource):
    """``spark.read.format("file_listing").load(path)``: (path, name, parent, size_bytes, last_modified) of all files below."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


def listed(spark: SparkSession, path: str, folders: int = 64) -> DataFrame:
    """All files below a path. ``folders`` says how many folders the driver finds before tasks take over."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("path", path).option("folders", folders).load()
