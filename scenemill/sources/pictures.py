"""Sizes of PNG and JPEG pictures from their heads, read by range."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .archives import opened

PNG = b"\x89PNG\r\n\x1a\n"
# fixed values: JPEG markers that begin a frame, and those without a length
FRAMES, BARE = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}, {0x01, *range(0xD0, 0xD9)}


def picture_size(handle) -> tuple[int, int]:
    """Width and height."""
    head = handle.read(24)
    if head[:8] == PNG and head[12:16] == b"IHDR":
        return struct.unpack(">II", head[16:24])
    if head[:2] != b"\xff\xd8":
        raise ValueError("neither PNG nor JPEG")
    at = 2
    while True:
        handle.seek(at)
        mark = handle.read(9)
        if len(mark) < 9 or mark[0] != 0xFF:
            raise ValueError("a JPEG without a frame")
        if mark[1] in FRAMES:
            height, width = struct.unpack(">HH", mark[5:9])
            return width, height
        at += 1 if mark[1] == 0xFF else 2 if mark[1] in BARE else 2 + struct.unpack(">H", mark[2:4])[0]


def picture_sizes(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """input, width, height of every picture below a folder; of one that cannot be read both are null. Spark lists them, tasks read their heads."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name in batch.column(0).to_pylist():
                try:
                    with opened(name) as handle:
                        sizes.append(picture_size(handle))
                except (ValueError, struct.error):
                    sizes.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1))], names=["input", "width", "height"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    return files.mapInArrow(rows, "input string, width int, height int")
