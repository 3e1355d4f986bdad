"""Read folders as listing tables, and the contents of listed files."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioframe.operators.snapshot import select_listing
from folioframe.schemas import FORMATS

# Folders are opened level by level until there are this many, each a partition of its own.
FOLDERS = 256
# Bytes of file contents in one Arrow batch; a larger file is a batch of its own.
BATCH_BYTES = 1 << 25


def plain_path(path: str) -> str:
    """Path without the ``file:`` scheme."""
    return re.sub(r"^file:/+", "/", path)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _entries(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """Entries of one folder without hidden ones; none if it has gone meanwhile."""
    selector = fs.FileSelector(folder, recursive=False, allow_not_found=True)
    return [e for e in files.get_file_info(selector) if not e.base_name.startswith(".")]


class _Folder(InputPartition):
    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Folder]:
        """One for each folder; those of the last level that was opened include all that is below them."""
        files, root = _opened(self.root)
        done, level = [], [root]
        while level and len(done) + len(level) < FOLDERS:
            done += level
            level = [e.path for folder in level for e in _entries(files, folder) if e.type == fs.FileType.Directory]
        return [_Folder(f, False) for f in done] + [_Folder(f, True) for f in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        files, root = _opened(self.root)
        # What an address has in front of the path that the file system itself uses.
        prefix = self.root[: len(self.root) - len(root)] if self.root.endswith(root) else ""
        folders = [partition.path]
        while folders:
            for e in _entries(files, folders.pop()):
                if e.type == fs.FileType.Directory and partition.below:
                    folders.append(e.path)
                elif e.type == fs.FileType.File:
                    yield prefix + e.path, e.size, dt.datetime.fromtimestamp(e.mtime_ns / 1e9, dt.timezone.utc)


class FolderListing(DataSource):
    """Files of a folder tree: path, size_bytes, modified_at. File contents are not read."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path STRING, size_bytes BIGINT, modified_at TIMESTAMP"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def scan_listing(
    spark: SparkSession, root: str, formats: list[str] = FORMATS, ignore: str = ""
) -> DataFrame:
    """Listing of a folder tree, ordered by path; file contents are not read.

    Hidden files and folders (names that start with ``.``) are skipped; names that start with ``_`` are listed, which
    Spark's own file sources leave out. Executors list the folders and need the file system that ``root`` names.
    """
    spark.dataSource.register(FolderListing)
    files = spark.read.format("folder_listing").load(plain_path(root).rstrip("/") or "/")
    return select_listing(files, formats, ignore).orderBy("path")


def read_contents(listing: DataFrame) -> DataFrame:
    """(path, format, content) of the files of a listing (path, format); a file that has gone meanwhile has no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.large_binary())],
                ["path", "format", "content"],
            )

        rows, size = [], 0
        for part in batches:
            for path, kind in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                files, place = _opened(path)
                try:
                    with files.open_input_stream(place) as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue
                rows.append((path, kind, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return listing.select("path", "format").mapInArrow(read, "path STRING, format STRING, content BINARY")
