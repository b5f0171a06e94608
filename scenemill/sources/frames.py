"""Arrays of HDF5 files (renders: colours, depth, masks), read by range: the tables of a file, and the chunks of the named datasets.

Read is what renderers write by default: superblock 0 or 1, groups by B-tree and local heap, datasets of numbers or fixed
strings, compact, contiguous or in chunks, with deflate, byte shuffle and checksums (which are dropped, not checked). Anything else
is an error that names the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .archives import opened

SIGNATURE, NOWHERE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
# fixed values: message and filter numbers of the format
SPACE, TYPE, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


class File:
    """A file of eight-byte offsets, by range."""

    def __init__(self, handle):
        self.handle = handle
        head = self.at(0, 96)
        if head[:8] != SIGNATURE or head[8] > 1 or head[13:15] != b"\x08\x08":
            raise ValueError("not an HDF5 file of superblock 0 or 1 with offsets of eight bytes")
        start = 24 if head[8] == 0 else 28
        self.base = struct.unpack_from("<Q", head, start)[0]
        self.root = struct.unpack_from("<Q", head, start + 40)[0]

    def at(self, offset: int, size: int) -> bytes:
        self.handle.seek(offset)
        data = self.handle.read(size)
        return data if len(data) == size or not offset else data.ljust(size, b"\0")

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        """Number and body of each message of an object."""
        version, count, size = struct.unpack("<BxHxxxxI", self.at(self.base + address, 12))
        if version != 1:
            raise ValueError("object headers of this version are not read")
        blocks = [(address + 16, size)]
        while blocks and count > 0:
            start, size = blocks.pop(0)
            data, at = self.at(self.base + start, size), 0
            while at + 8 <= size and count > 0:
                kind, long = struct.unpack_from("<HH", data, at)
                body = data[at + 8 : at + 8 + long]
                if kind == CONTINUED:
                    blocks.append(struct.unpack_from("<QQ", body))
                yield kind, body
                at, count = at + 8 + long, count - 1

    def leaves(self, address: int, key: int) -> Iterator[tuple[bytes, int]]:
        """First key and address of each child at the bottom of a B-tree whose keys have so many bytes."""
        mark, level, used = struct.unpack("<4sxBH", self.at(self.base + address, 8))
        if mark != b"TREE":
            raise ValueError("a B-tree node is missing")
        data = self.at(self.base + address + 24, used * (key + 8) + key)
        for k in range(used):
            child = struct.unpack_from("<Q", data, k * (key + 8) + key)[0]
            if level:
                yield from self.leaves(child, key)
            else:
                yield data[k * (key + 8) : k * (key + 8) + key], child

    def members(self, address: int) -> dict[str, int]:
        """Names and addresses of what a group holds; empty for a dataset."""
        table = next((body for kind, body in self.messages(address) if kind == SYMBOLS), None)
        if table is None:
            return {}
        tree, heap = struct.unpack_from("<QQ", table)
        size, _, where = struct.unpack("<QQQ", self.at(self.base + heap + 8, 24))
        names, out = self.at(self.base + where, size), {}
        for _, node in self.leaves(tree, 8):
            mark, count = struct.unpack("<4sxxH", self.at(self.base + node, 8))
            if mark != b"SNOD":
                raise ValueError("a symbol table node is missing")
            entries = self.at(self.base + node + 8, 40 * count)
            for k in range(count):
                name, target = struct.unpack_from("<QQ", entries, 40 * k)
                out[names[name : names.index(b"\0", name)].decode()] = target
        return out

    def datasets(self, address: int | None = None, prefix: str = "") -> Iterator[tuple[str, int]]:
        """Names, groups before a slash, and addresses of all datasets."""
        for name, target in sorted(self.members(self.root if address is None else address).items()):
            kinds = {kind for kind, _ in self.messages(target)}
            if SYMBOLS in kinds:
                yield from self.datasets(target, f"{prefix}{name}/")
            elif LAYOUT in kinds:
                yield prefix + name, target

    def array(self, address: int) -> np.ndarray:
        given = Given()
        for kind, body in self.messages(address):
            given.take(kind, body)
        return given.read(self)


@dataclass
class Given:
    """What an object's messages say of a dataset."""

    shape: tuple[int, ...] = ()
    dtype: np.dtype | None = None
    layout: bytes = b""
    filters: list[tuple[int, int]] = field(default_factory=list)

    def take(self, kind: int, body: bytes) -> None:
        if kind == SPACE:
            rank, start = body[1], 8 if body[0] == 1 else 4
            self.shape = struct.unpack_from(f"<{rank}Q", body, start)
        elif kind == TYPE:
            what, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
            order = ">" if bits & 1 else "<"
            if what not in (0, 1, 3) or (what == 1 and size not in (2, 4, 8)):
                raise ValueError("datasets of this type are not read")
            self.dtype = np.dtype({0: f"{order}{'i' if bits & 8 else 'u'}{size}", 1: f"{order}f{size}", 3: f"S{size}"}[what])
        elif kind == LAYOUT:
            self.layout = body
        elif kind == FILTERS:
            at = 8 if body[0] == 1 else 2
            for _ in range(body[1]):
                number = struct.unpack_from("<H", body, at)[0]
                long = struct.unpack_from("<H", body, at + 2)[0] if body[0] == 1 or number >= 256 else 0
                at += 4 if body[0] == 1 or number >= 256 else 2
                values = struct.unpack_from("<H", body, at + 2)[0]
                at += 4 + (-(-long // 8) * 8 if body[0] == 1 else long)
                self.filters.append((number, struct.unpack_from("<I", body, at)[0] if values else 0))
                at += 4 * (values + (values % 2 if body[0] == 1 else 0))

    def plain(self, data: bytes, mask: int) -> bytes:
        """A chunk without its filters, the last one first; those that the mask names were left out."""
        for k, (number, value) in reversed(list(enumerate(self.filters))):
            if mask >> k & 1:
                continue
            if number == DEFLATE:
                data = zlib.decompress(data)
            elif number == SHUFFLE:
                whole = len(data) // value * value
                data = np.frombuffer(data[:whole], np.uint8).reshape(value, -1).T.tobytes() + data[whole:]
            elif number == CHECKSUM:
                data = data[:-4]
            else:
                raise ValueError(f"filter {number} is not read")
        return data

    def read(self, file: File) -> np.ndarray:
        if self.dtype is None or self.layout[:1] != b"\x03":
            raise ValueError("a dataset of another layout is not read")
        size = int(np.prod(self.shape)) * self.dtype.itemsize
        if self.layout[1] == 0:
            return np.frombuffer(self.layout[4 : 4 + size], self.dtype).reshape(self.shape)
        if self.layout[1] == 1:
            address = struct.unpack_from("<Q", self.layout, 2)[0]
            return np.frombuffer(bytes(size) if address == NOWHERE else file.at(file.base + address, size), self.dtype).reshape(self.shape)
        rank, tree = self.layout[2] - 1, struct.unpack_from("<Q", self.layout, 3)[0]
        chunk, out = struct.unpack_from(f"<{rank}I", self.layout, 11), np.zeros(self.shape, self.dtype)
        if tree != NOWHERE:
            for key, address in file.leaves(tree, 8 + 8 * (rank + 1)):
                stored, mask, *start = struct.unpack_from(f"<II{rank}Q", key)
                part = np.frombuffer(self.plain(file.at(file.base + address, stored), mask), self.dtype).reshape(chunk)
                into = tuple(slice(s, min(s + c, n)) for s, c, n in zip(start, chunk, self.shape))
                out[into] = part[tuple(slice(0, i.stop - i.start) for i in into)]
        return out


def read_frames(spark: SparkSession, path: str, datasets: list[str] | None = None, pattern: str = "*.hdf5") -> DataFrame:
    """path, dataset, dtype, shape, data (little-endian, rows first) of each named dataset (all, if none is named) of every file below a folder.

    Spark lists the files; a task opens its own and reads the tables and the named datasets only. A name that a file lacks is an error.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with opened(name) as handle:
                        file = File(handle)
                        known = dict(file.datasets())
                        lacks = [d for d in datasets or () if d not in known]
                        if lacks:
                            raise ValueError(f"no dataset {', '.join(lacks)}")
                        arrays = [(d, file.array(known[d])) for d in (datasets or known)]
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e
                for d, a in arrays:
                    a = a.astype(a.dtype.newbyteorder("<"), copy=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([d]), pa.array([a.dtype.str]), pa.array([list(a.shape)], pa.list_(pa.int64())), pa.array([a.tobytes()], pa.binary())],
                        names=["path", "dataset", "dtype", "shape", "data"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    return files.mapInArrow(rows, "path string, dataset string, dtype string, shape array<long>, data binary")
