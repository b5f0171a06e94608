r"""Web archives: records written by Spark, indexed by offset, and read back by byte range.

Writing. Of the records whose payloads are equal (by SHA-1 and length) and at least `min_bytes` long, the
one with the smallest page_id is a response; the others are revisits that name it and hold no payload.
Smaller payloads are all responses. Rows that share page_id and payload are one page written more than
once. The records go out through Spark's text writer with `\r\n\r\n`, the mark that ends a WARC record,
as the line separator: each task's file is a valid archive, and the committer deals with lost tasks.

Index. One pass over the archives notes offset, length, URL, digest and type per record and is itself
stored before anything is read by offset.

Reading. The selected index rows are sorted by archive and offset, and ranges at most GAP apart join into
one read of up to READ bytes. Range partitions spread one large archive over many tasks.

Null html is an empty payload; null urls become urn:page:<id>; a null page_id comes after all others and
is written as an empty id. Line breaks in a url are percent-coded in its header, so the index shows
them so. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import new_path, stored

DATE = "2024-01-01T00:00:00Z"
GAP, READ, SCAN = 1 << 16, 1 << 23, 1 << 22
END = b"\r\n\r\n"
# fixed values: the digits Spark's conv writes, and those of RFC 4648 base32
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(text: Column) -> Column:
    """The bare base32 SHA-1 of a column's UTF-8 bytes: five hex digits make four of base32."""
    sha = F.sha1(F.encode(text, "UTF-8"))
    return F.translate(
        F.concat(*[F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), CONV_DIGITS, BASE32_DIGITS
    )


def described(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.format_string("urn:page:%s", F.col("page_id"))).alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"),
        base32_sha1(html).alias("digest"),
    )


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, bytes, digest, refers_to of the pages whose payload an earlier page has.

    Groups are found by a combining aggregate; only groups of two pages or more are joined back, and of
    a very large one Spark splits the pages' side.
    """
    plain = described(pages).drop("html").where(F.col("bytes") >= min_bytes)
    groups = (
        plain.groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("refers_to").isNotNull())
        .drop("n")
    )
    return plain.join(groups, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))


def _record(kind: str, http: Column, payload: Column) -> Column:
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
    ]
    if kind == "revisit":
        lines += [F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")]
    length = F.length(http) + (F.col("bytes") if kind == "response" else F.lit(0))
    lines += [F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), http]
    return F.concat(*lines, payload)


def write_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write all pages as archives and return their folder.

    Which pages are revisits is stored first. It is small beside the pages, and Spark sends it to the
    tasks if its size allows; else the join is a shuffle.
    """
    spark = pages.sparkSession
    again = stored(revisits(pages, min_bytes), "warc-revisits")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    keys = again.select(F.col("page_id").alias("k"), F.col("digest").alias("d"), F.col("bytes").alias("b"))
    all_pages = described(pages)
    responses = all_pages.join(
        keys.distinct(), (F.col("page_id").eqNullSafe(F.col("k"))) & (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left_anti"
    )
    records = responses.select(_record("response", http, F.col("html")).alias("value")).unionByName(
        again.select(_record("revisit", http, F.lit("")).alias("value"))
    )
    path = new_path(spark, "warc")
    records.write.option("lineSep", END.decode()).text(path)
    return path


def _open(uri: str) -> pa.NativeFile:
    """s3a is read as s3. A store that Arrow has no file system for is an error that names it."""
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system.open_input_file(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)


def _scan(archive: str) -> Iterator[tuple]:
    """(archive, offset, length, url, digest, type) of each record, from one pass of fixed-size reads.

    Only heads are looked at; a payload is stepped over without being held.
    """
    with _open(archive) as f:
        size, at, base, held = f.size(), 0, 0, b""
        while at < size:
            stop = held.find(END, at - base)
            while stop < 0 and base + len(held) < size:
                held, base = held[at - base :] + f.read_at(SCAN, base + len(held)), at
                stop = held.find(END)
            if stop < 0:
                raise ValueError(f"{archive}: no whole record at {at}")
            fields = _fields(held[at - base : stop])
            length = stop + len(END) - (at - base) + int(fields[b"Content-Length"]) + len(END)
            yield archive, at, length, fields[b"WARC-Target-URI"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), fields[b"WARC-Type"].decode()
            at += length
            if at > base + len(held):
                held, base = b"", at


def index(path: str, spark) -> DataFrame:
    """The stored index of a folder of archives."""
    names = ["archive", "offset", "length", "url", "digest", "record_type"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for row in _scan(archive):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path")
    return stored(files.mapInArrow(scan, "archive string, offset long, length long, url string, digest string, record_type string"), "warc-index")


def coalesced(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, offset, end) of each read over rows sorted by offset."""
    first = 0
    for i in range(1, len(rows) + 1):
        start, end = rows[first][0], max(r[0] + r[1] for r in rows[i - 1 : i])
        if i == len(rows) or rows[i][0] - end > GAP or rows[i][0] + rows[i][1] - start > READ:
            yield first, i, start, end
            first = i


def read_records(selected: DataFrame, partitions: int) -> DataFrame:
    """Read the records of index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, offset, length.

    A response's length and digest are those of the bytes read and must agree with its head; a revisit has
    no payload, so its own head gives both.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list = [None, None]
        for batch in batches:
            wanted = batch.to_pylist()
            for name in dict.fromkeys(w["archive"] for w in wanted):
                rows = [w for w in wanted if w["archive"] == name]
                if opened[0] != name:
                    if opened[1]:
                        opened[1].close()
                    opened = [name, _open(name)]
                for first, last, start, end in coalesced([(w["offset"], w["length"]) for w in rows]):
                    data = opened[1].read_at(end - start, start)
                    out = [_parsed(data[w["offset"] - start : w["offset"] - start + w["length"]], w) for w in rows[first:last]]
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
        if opened[1]:
            opened[1].close()

    ranges = selected.select("archive", "offset", "length").repartitionByRange(partitions, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long")


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _number(field: bytes | None) -> int | None:
    digits = field[len(b"<urn:page:") : -1] if field else b""
    return int(digits) if digits else None


def _parsed(record: bytes, row: dict) -> dict:
    head, _, rest = record.partition(END)
    fields = _fields(head)
    http, _, payload = rest.partition(END)
    declared, kind = int(_fields(http)[b"Content-Length"]), fields[b"WARC-Type"].decode()
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response":
        payload = payload[:-len(END)]
        if len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{row['archive']}: the record at {row['offset']} is damaged")
    return {
        "page_id": _number(fields[b"WARC-Record-ID"]), "payload_bytes": declared, "payload_digest": digest, "record_type": kind,
        "refers_to": _number(fields.get(b"WARC-Refers-To")), "url": fields[b"WARC-Target-URI"].decode(), **row,
    }


def round_trip(pages: DataFrame, min_bytes: int = 0, bytes_a_task: int = 1 << 25) -> DataFrame:
    """Write all pages, index the archives, read every record back."""
    found = index(write_archives(pages, min_bytes), pages.sparkSession)
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return read_records(found, max(1, -(-total // bytes_a_task)))
