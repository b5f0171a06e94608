"""Members of ZIP archives as rows, and ranges of files, by Arrow's file systems (local, S3, HDFS, ...).

An archive is never read whole: its directory, at its end, is read by range, members are dealt to partitions by
their compressed size, and each task reads and inflates its own.
"""

from __future__ import annotations

import fnmatch
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 64 << 20


def opened(path: str) -> pa.NativeFile:
    """A file that can be read by range. Spark writes local paths as file:/..., which Arrow does not know."""
    local = re.match(r"^(?:file:(?://)?)?(/.*)$", path)
    if local:
        return fs.LocalFileSystem().open_input_file(local[1])
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def members(archive: zipfile.ZipFile, pattern: str) -> list[zipfile.ZipInfo]:
    """Files of an archive whose name fits, in the order in which they lie in it."""
    return sorted((m for m in archive.infolist() if not m.is_dir() and fnmatch.fnmatchcase(m.filename, pattern)), key=lambda m: m.header_offset)


@dataclass
class Run(InputPartition):
    path: str
    first: int
    last: int


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.pattern, self.size = options["path"].split(","), options.get("pattern", "*"), int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Run]:
        out = []
        for path in self.paths:
            with opened(path) as f, zipfile.ZipFile(f) as archive:
                found = members(archive, self.pattern)
            first = held = 0
            for k, m in enumerate(found, 1):
                held += m.compress_size
                if held >= self.size or k == len(found):
                    out.append(Run(path, first, k))
                    first, held = k, 0
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if partition.first == partition.last:
            return
        with opened(partition.path) as f, zipfile.ZipFile(f) as archive:
            for m in members(archive, self.pattern)[partition.first : partition.last]:
                yield partition.path, m.filename, m.file_size, archive.read(m)


class ZipMembers(DataSource):
    """archive, name, size, content of each member. Options: path (several with commas), pattern (of names), partbytes."""

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return "archive string, name string, size long, content binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def read_members(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zipmembers").option("path", path).option("pattern", pattern).option("partbytes", part_bytes).load()
