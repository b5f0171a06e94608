"""Exact removal of repeated byte strings through bucketed, enhanced suffix arrays.

A byte goes if it lies in a LENGTH-byte string that also starts earlier: in a document of smaller doc_id,
or in the same one at an earlier byte. Strings never cross documents and are judged on the input.

Buckets. Each LENGTH-byte window has an anchor, the GRAM bytes in it of least hash (the first, if equal).
Equal windows have equal anchors at equal places, so windows are compared only among those of one anchor.
All windows of one anchor in one place form a segment, cut out by its first and last window. One row goes
out per segment, with hashes of the anchor and of the segment; a task sends equal segments once and marks
the later ones itself, so a passage that stands everywhere sends a row per task.

Suffix arrays. Segments that are equal need no comparing: all but the first are removed. Where an anchor has
unlike segments, their bytes are fetched and the suffixes that start at the anchor are sorted, with the
lengths of their common prefixes. A stack scan of these gives the intervals of the prefix tree: each is a
set of occurrences with the same longest right extension. In each interval the left contexts, reversed,
are sorted and scanned the same way: where they begin to differ the repeat cannot be extended to the left
(the test of left diversity). Each pair of intervals whose extensions add up to LENGTH or more is a
maximal repeat with all its occurrences; all but the first are removed.

Large groups. The segments of an anchor are scanned in one task, GROUP of them at most. A larger group is dealt
further, by the place of a window's start before the anchor: windows that start up to `mid` bytes before it share
LENGTH - mid bytes from the anchor on, the others share mid + 1 bytes before it, and each half is dealt by those bytes.
In a half a segment is cut to the bytes of its windows there. Segments that are now the same bytes need no comparing: all
but the first are removed there, and the first alone goes on. Halving goes on for the groups that are still too large;
where one place is left all windows of a group are the same bytes, so one is left. No window is left out at any size, and
what a scan finds are repeats in the texts themselves, whatever the hashes that dealt them.

Null texts are empty. Rows with equal doc_id and equal text are one document and get equal results; rows
of one doc_id with unlike texts are documents ordered by the CRC-32 of their texts. A null doc_id comes
first; ids are integers. An empty table gives an empty result. Other columns are kept by `without_repeats` only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, running_sum, span_hash
from .storage import free_name, integer_id, stored

# GROUP segments are about 400 kB
LENGTH, GRAM, GROUP, SALTS = 100, 32, 2000, 16
SLICE = 1 << 22
FIRST_ID = -(1 << 63)


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` values in a row, the least."""
    m, have = v, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - have :]) if have < width else m


def segments(text: bytes) -> tuple[np.ndarray, ...]:
    """anchor hash, segment hash, anchor place, first window, last window, of each segment in order."""
    width = LENGTH - GRAM + 1
    parts = []
    for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
        piece = np.frombuffer(text, np.uint8, min(len(text) - at, SLICE + LENGTH - 1), at)
        if len(piece) < LENGTH:
            continue
        sums = running_sum(piece)
        place = np.arange(len(piece) - GRAM + 1)
        h = span_hash(sums, place, place + GRAM)
        low = np.uint64((1 << 24) - 1)
        q = (_window_minima((h & ~low) | place.astype(np.uint64), width) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(q, prepend=-1))
        last = np.append(first[1:], len(q)) - 1
        q = q[first]
        seg = mix(span_hash(sums, first, last + LENGTH) + (q - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        parts.append((h[q], seg, q + at, first + at, last + at))
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans united where they overlap or touch, in order."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    fresh = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
    return start[fresh], stop[np.append(fresh[1:], len(stop)) - 1]


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def prefix_intervals(sorted_strings: list[bytes], least: int) -> Iterator[tuple[int, int, int]]:
    """(prefix length, first, last) of each interval of the common-prefix tree, of `least` bytes and more."""
    stack: list[tuple[int, int]] = []
    n = len(sorted_strings)
    for i in range(1, n + 1):
        depth = common_prefix(sorted_strings[i - 1], sorted_strings[i]) if i < n else -1
        start = i - 1
        while stack and stack[-1][0] > depth:
            d, start = stack.pop()
            if d >= least:
                yield d, start, i - 1
        if i < n and (not stack or stack[-1][0] < depth):
            stack.append((depth, start))


def maximal_repeats(occurrences: list[tuple[bytes, bytes]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, numbers of all occurrences) of each maximal repeat of `length` bytes or more.

    occurrences: the bytes to the left of a common anchor, reversed, and those from it on.
    """
    by_right = sorted(range(len(occurrences)), key=lambda i: occurrences[i][1])
    for right, lo, hi in prefix_intervals([occurrences[i][1] for i in by_right], 1):
        by_left = sorted(by_right[lo : hi + 1], key=lambda i: occurrences[i][0])
        for left, a, b in prefix_intervals([occurrences[i][0] for i in by_left], max(0, length - right)):
            yield left, right, by_left[a : b + 1]


def _columns(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


SEGMENT = ["anchor", "seg", "doc", "crc", "place", "start", "stop"]
SEGMENT_SCHEMA = "anchor long, seg long, doc long, crc long, place int, start int, stop int"


def _segment_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SEGMENT: segments, equal ones once, and under place -1 the spans of the others, united."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [(t or "").encode() for t in batch.column(1).to_pylist()]
        docs = sorted((i, zlib.crc32(t), k) for k, (i, t) in enumerate(zip(ids, texts)))
        docs = [d for n, d in enumerate(docs) if n == 0 or d[:2] != docs[n - 1][:2]]
        held = [segments(texts[k]) for _, _, k in docs]
        doc = np.repeat(np.arange(len(docs)), [len(x[0]) for x in held])
        if not len(doc):
            continue
        anchor, seg, place, start, stop = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, doc, seg, anchor))
        again = np.append(False, (anchor[order][1:] == anchor[order][:-1]) & (seg[order][1:] == seg[order][:-1]))
        keep, later = order[~again], order[again]
        number, crc = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
        yield _columns(SEGMENT, anchor[keep].astype(np.int64), seg[keep].astype(np.int64), number[doc[keep]], crc[doc[keep]], *(x[keep].astype(np.int32) for x in (place, start, stop)))
        if len(later):
            wide = np.int64(1 << 32)  # spans of one document after another, far apart
            s, e = merged(doc[later] * wide + start[later], doc[later] * wide + stop[later] + LENGTH)
            d = s // wide
            spread = mix(d.astype(np.uint64) + np.uint64(zlib.crc32(str(docs[0]).encode()))).astype(np.int64)
            yield _columns(SEGMENT, spread, np.zeros(len(d), np.int64), number[d], crc[d], np.full(len(d), -1, np.int32), (s % wide).astype(np.int32), (e - d * wide).astype(np.int32))


FOUND = ["doc", "crc", "start", "stop", "anchor", "place"]
FOUND_SCHEMA = "doc long, crc long, start int, stop int, anchor long, place int"


def _found(arrays: dict, at: np.ndarray, wanted: bool) -> pa.RecordBatch:
    """Spans to remove, or, wanted, segments whose bytes must be compared (anchor and place are then set)."""
    x = {k: v[at] for k, v in arrays.items()}
    if wanted:
        return _columns(FOUND, x["doc"], x["crc"], x["start"], x["stop"], x["anchor"], x["place"])
    stop = np.where(x["place"] < 0, x["stop"], x["stop"] + LENGTH).astype(np.int32)
    return _columns(FOUND, x["doc"], x["crc"], x["start"], stop, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()))


def _compare_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows from segments sorted by anchor, segment and document. One row is carried between batches."""
    last: dict | None = None  # the last row that is not a span
    pending = False  # whether it is the only segment of its anchor so far
    for batch in batches:
        x = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(SEGMENT)}
        ready = np.flatnonzero(x["place"] < 0)
        if len(ready):
            yield _found(x, ready, False)
        rows = np.flatnonzero(x["place"] >= 0)
        if not len(rows):
            continue
        x = {k: v[rows] for k, v in x.items()}
        if last is not None:
            x = {k: np.concatenate([last[k], v]) for k, v in x.items()}
        n, old = len(x["anchor"]), int(last is not None)
        same = {k: np.append(False, x[k][1:] == x[k][:-1]) for k in ("anchor", "seg", "doc", "crc", "place")}
        new_anchor = ~same["anchor"]
        new_seg = new_anchor | ~same["seg"]
        repeated = same["doc"] & same["crc"] & same["place"] & ~new_seg
        later = np.flatnonzero(~new_seg & ~repeated)
        if len(later):
            yield _found(x, later, False)
        group = np.cumsum(new_anchor) - 1
        segs = np.bincount(group[new_seg])
        unlike = segs[group] > 1
        if old and not pending:
            unlike |= group == 0  # the carried anchor had unlike segments before
        ask = new_seg & unlike
        if old and not pending:
            ask[0] = False  # asked for already
        if ask.any():
            yield _found(x, np.flatnonzero(ask), True)
        # carry the last segment's first row; equal segments follow it, if any
        tail = np.flatnonzero(new_seg)[-1]
        pending = bool(segs[group[-1]] == 1 and not unlike[-1])
        last = {k: v[tail : tail + 1] for k, v in x.items()}


CONTEXT_SCHEMA = "anchor long, doc long, crc long, place int, start int, bytes binary"


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, doc, crc, place, start, bytes of each wanted segment."""
    names = ["anchor", "doc", "crc", "place", "start", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
            rows = []
            for doc, crc, text, wanted in zip(*(c.to_pylist() for c in part.columns)):
                text = text.encode()
                rows += [(w["anchor"], doc, crc, w["place"], w["start"], text[w["start"] : w["stop"] + LENGTH]) for w in wanted]
            if rows:
                yield _columns(names, *[pa.array(c, t) for c, t in zip(zip(*rows), types)])


def _dealt(contexts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Segments dealt into groups by `anchor`: frames whose groups are to be scanned, and frames of spans found on the way."""
    scanned, spans = [], []
    rest = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(LENGTH - GRAM)})
    before, whole, mid = F.col("place") - F.col("start"), F.octet_length("bytes"), F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    while True:
        many = rest.where("lo < hi").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
        large = stored(many.select("anchor", F.lit(True).alias("large")), "large")
        if not large.head(1):
            return [*scanned, rest], spans
        salts = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(SALTS)).cast("int"))
        marked = salted.join(salts, ["anchor", "salt"], "left").drop("salt")  # read twice: with few large groups that is less than to write all
        scanned.append(marked.where("large is null").drop("large"))
        key = lambda at, n, side: F.xxhash64("anchor", F.lit(side), F.substr("bytes", at + 1, n))
        half = lambda k, lo, hi: F.struct(k.alias("anchor"), lo.alias("lo"), hi.alias("hi"))
        right = F.when(whole - before >= LENGTH - mid, half(key(before, LENGTH - mid, 0), F.col("lo"), mid))
        left = F.when(before > mid, half(key(before - mid - 1, mid + 1, 1), mid + 1, F.col("hi")))
        to = marked.where("large").withColumn("to", F.explode(F.array_compact(F.array(right, left)))).select("to.anchor", "doc", "crc", "place", "start", "bytes", "to.lo", "to.hi")
        # a half is cut to its own windows, and of those that are then alike the first goes on
        skip = F.greatest(before - F.col("hi"), F.lit(0))
        cut = to.withColumns({"start": F.col("start") + skip, "bytes": F.substr("bytes", skip + 1, F.least(whole, before - F.col("lo") + LENGTH) - skip)})
        halves = stored(cut, "halves")
        alike = ["anchor", "lo", "hi", "before", "bytes"]
        firsts = stored(halves.groupBy(*alike[:3], before.alias("before"), "bytes").agg(F.min(F.struct("doc", "crc", "place")).alias("first"), F.count("*").alias("n")), "firsts")
        later = halves.withColumn("before", before).join(firsts.where("n > 1").drop("n"), alike).where(F.struct("doc", "crc", "place") != F.col("first"))
        spans.append(later.select("doc", "crc", "start", (F.col("start") + whole).alias("stop")))
        rest = firsts.select("anchor", "first.doc", "first.crc", "first.place", (F.col("first.place") - F.col("before")).alias("start"), "bytes", "lo", "hi")


def _scan_suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, crc, start, stop of what is not first in some maximal repeat, from rows sorted by anchor, document, place and start.

    Where a text of several slices is parted, one segment comes as two rows of one place: they share LENGTH - 1 bytes,
    too few to match each other, and each is compared with all others.
    """
    group: list[dict] = []
    out: list[tuple] = []

    def close():
        # all spans of one segment hold the anchor, so together they are one span
        contexts = [(g["bytes"][: g["place"] - g["start"]][::-1], g["bytes"][g["place"] - g["start"] :]) for g in group]
        reach: dict[int, tuple[int, int]] = {}
        for left, right, members in maximal_repeats(contexts):
            first = min(members)
            for i in members:
                if i != first:
                    l, r = reach.get(i, (0, 0))
                    reach[i] = max(l, left), max(r, right)
        out.extend((group[i]["doc"], group[i]["crc"], group[i]["place"] - l, group[i]["place"] + r) for i, (l, r) in reach.items())

    def flush():
        columns = list(zip(*out))
        out.clear()
        return _columns(["doc", "crc", "start", "stop"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()))

    for batch in batches:
        for row in batch.to_pylist():
            if group and group[0]["anchor"] != row["anchor"]:
                close()
                group = []
                if len(out) > 20_000:
                    yield flush()
            same = group and all(group[-1][k] == row[k] for k in ("doc", "crc", "place", "start"))
            if not same:
                group.append(row)
    if group:
        close()
    if out:
        yield flush()


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, str, str, DataFrame]:
    """docs with two more columns, which name a document; their names; and doc, crc, spans (each document's spans to remove, not united)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc, crc = free_name(docs, "_doc"), free_name(docs, "_crc")
    keyed = docs.withColumn(doc, F.coalesce(integer_id(docs, "doc_id"), F.lit(FIRST_ID))).withColumn(crc, F.crc32(F.encode(text, "UTF-8")))
    rows = keyed.select(doc, "text").mapInArrow(_segment_rows, SEGMENT_SCHEMA)
    found = stored(
        rows.repartition("anchor").sortWithinPartitions("anchor", "seg", "doc", "crc", "place").mapInArrow(_compare_segments, FOUND_SCHEMA), "segments"
    )
    asked = found.where("anchor is not null").groupBy("doc", "crc").agg(F.collect_list(F.struct("anchor", "place", "start", "stop")).alias("wanted"))
    texts = keyed.select(F.col(doc).alias("doc"), F.col(crc).alias("crc"), "text").where(F.length("text") > 0)
    got = stored(texts.join(asked, ["doc", "crc"]).select("doc", "crc", "text", "wanted").mapInArrow(_fetch, CONTEXT_SCHEMA), "contexts")
    spans = found.where("anchor is null").select("doc", "crc", "start", "stop")
    scanned, later = _dealt(got)
    for part in scanned:
        ordered = part.select(*got.columns).repartition("anchor").sortWithinPartitions("anchor", "doc", "crc", "place", "start")
        spans = spans.unionByName(ordered.mapInArrow(_scan_suffixes, "doc long, crc long, start int, stop int"))
    for part in later:
        spans = spans.unionByName(part)
    # one span for each start, and so no more of them than bytes
    longest = spans.repartition("doc", "crc").groupBy("doc", "crc", "start").agg(F.max("stop").alias("stop"))
    return keyed, doc, crc, longest.groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs and, as the last column, their spans."""
    keyed, doc, crc, spans = repeated_spans(docs)
    named = [free_name(docs, n) for n in ("_d", "_c", "_spans")]
    found = spans.toDF(*named)
    return keyed.join(found, (F.col(doc) == F.col(named[0])) & (F.col(crc) == F.col(named[1])), "left").select(*docs.columns, named[2])


def _cut(text: bytes, spans: list | None) -> tuple[np.ndarray, np.ndarray]:
    return merged(*(np.array([s[k] for s in spans or []], np.int64) for k in ("start", "stop")))


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = (text or "").encode()
                start, stop = _cut(text, spans)
                digest = hashlib.sha256()
                for a, b in zip(np.append(0, stop), np.append(start, len(text))):
                    digest.update(text[a:b])
                out.append((len(text), int((stop - start).sum()), len(start), digest.hexdigest()))
            if out:
                yield _columns(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], batch.column(0), *zip(*out))

    return _with_spans(docs.select("doc_id", "text")).mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of text. Characters are kept whole: one that lies in a span in part stays."""
    names = docs.columns
    schema = docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index("text")
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                if spans:
                    raw = text.encode()
                    kept, at = [], 0
                    for a, b in zip(*_cut(raw, spans)):
                        a, b = int(a), int(b)
                        while a < len(raw) and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        if a < b:
                            kept.append(raw[at:a])
                            at = b
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_spans(docs).mapInArrow(rows, schema)
