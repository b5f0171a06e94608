"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of a length of
at least max(24, 3q), that no neighbouring word extends keeping period q. Words are bytes between ASCII white
space; they are told apart by themselves, not by hashes.

Periods below SHORT come from direct scans: for each lag, the stretches where a word equals the one `lag` later.

Longer periods are found by scale. The scale of Q takes the periods from Q up to one and a half Q. Blocks of Q
words are hashed; a window of Q block starts keeps its least block. In a run of such a period q the first
window and the one q words later both lie inside, see the same words, and so keep blocks q apart. Pairs of
equal kept blocks at a distance of the scale are candidates; each is extended both ways as far as words q
apart agree. A block whose own period is a third of Q or less is never kept: equal ones could stand at every
word. Such blocks lie in runs that earlier scales have found, each window of a run of this scale has another
block (else the run's period would be less), and those left repeat only every Q/3 words, so that a block has
a handful of partners at most. Extension goes by powers of two over a table of hashes of 1, 2, 4, ... words; runs
are then held against the words themselves.

Documents of a batch are searched together, longest first, parted by marks that equal no word, so that a scale
works on the documents that are long enough for it. Work is n log n in the words of a text; nothing is shuffled.

Null texts are empty: no words, no runs. A row with a null doc_id is described as it stands, with no words put in
its place. Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytehash import mix
from .storage import integer_id

LEAST, REPEATS, SHORT, BATCH = 24, 3, 16, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """From and to (not in it) of the periods of each scale, while a text of `longest` words can hold such a run."""
    q = SHORT
    while REPEATS * q <= longest:
        yield q, q + q // 2
        q += q // 2


def block_hashes(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each 1, 2, 4, ... words in a row, of the documents that have three times as many."""
    tables = [mix(ids.astype(np.uint64) * _STEP + np.uint64(1))]
    width = 1
    while True:
        some = int(np.count_nonzero(lengths >= REPEATS * 2 * width))
        if not some:
            return tables
        h = tables[-1][: ends[some - 1]]
        tables.append(mix(h[: len(h) - width] * _STEP + mix(h[width:] + np.uint64(width))))
        width *= 2


def least_of_windows(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w keys in a row."""
    n = len(keys) - w + 1
    if n <= 0:
        return keys[:0]
    whole = np.full(-(-len(keys) // w) * w, _NONE)
    whole[: len(keys)] = keys
    parts = whole.reshape(-1, w)
    before = np.minimum.accumulate(parts, axis=1).ravel()
    after = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def agreement(tables: list[np.ndarray], p: np.ndarray, d: np.ndarray, onward: bool) -> np.ndarray:
    """How many words from p on (or before p) equal those d later."""
    t = np.zeros(len(p), np.int64)
    for j in range(len(tables) - 1, -1, -1):
        h, width = tables[j], 1 << j
        live = np.arange(len(p))
        while len(live):
            at = p[live] + t[live] if onward else p[live] - t[live] - width
            fits = (at >= 0) & (at + d[live] < len(h))
            live, at = live[fits], at[fits]
            same = h[at] == h[at + d[live]]
            live = live[same]
            t[live] += width
    return t


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true that are at least so long."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def _candidates(tables: list[np.ndarray], end: int, q: int, below: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and distances of equal kept blocks at the scale [q, below)."""
    j = q.bit_length() - 1
    h = tables[j][:end]
    block = mix(h[: len(h) - (q - (1 << j))] * _STEP + h[q - (1 << j) :])
    runs = found[(found[:, 2] <= q // 3) & (found[:, 1] - found[:, 0] >= q) & (found[:, 0] < len(block))]
    cover = np.zeros(len(block) + 1, np.int64)
    np.add.at(cover, runs[:, 0], 1)
    np.add.at(cover, np.minimum(runs[:, 1] - q + 1, len(block)), -1)
    bits = np.uint64(len(block).bit_length())
    keys = (block >> bits << bits) | np.arange(len(block), dtype=np.uint64)
    keys[np.cumsum(cover[:-1]) > 0] = _NONE
    least = least_of_windows(keys, q)
    least = least[least != _NONE]
    at = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    at = np.unique(at)
    order = np.argsort(block[at], kind="stable")
    at, value = at[order], block[at[order]]
    p, d, k = [], [], 1
    while k < len(at):
        near = (value[k:] == value[:-k]) & (at[k:] - at[:-k] < below)
        if not near.any():
            break
        gap = (at[k:] - at[:-k])[near]
        p.append(at[:-k][near][gap >= q])
        d.append(gap[gap >= q])
        k += 1
    return (np.concatenate(p), np.concatenate(d)) if p else (at[:0], at[:0])


def find_runs(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, end, period of every run of three periods or more, of documents laid end to end, longest first.

    ids: a number per word, equal for equal words; a number of its own after each document. lengths: words of each.
    """
    ends = np.cumsum(lengths + 1)
    found = np.zeros((0, 3), np.int64)

    def add(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        rows = np.concatenate([found, np.stack([start, end, period], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        # a stretch that is a run of a divisor of the period, too, has the divisor
        return rows[np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])] if len(rows) else rows

    for lag in range(1, SHORT):
        some = int(np.count_nonzero(lengths >= REPEATS * lag))
        if some:
            part = ids[: ends[some - 1]]
            start, end = _stretches(part[lag:] == part[:-lag], (REPEATS - 1) * lag)
            found = add(start, end + lag, np.full(len(start), lag))
    tables = block_hashes(ids, lengths, ends)
    for q, below in scales(int(lengths[0]) if len(lengths) else 0):
        end = int(ends[np.count_nonzero(lengths >= REPEATS * q) - 1])
        p, d = _candidates(tables, end, q, below, found)
        if len(p):
            after, before = agreement(tables, p, d, True), agreement(tables, p, d, False)
            start, stop = p - before, p + after + d
            long = stop - start >= REPEATS * d
            found = add(start[long], stop[long], d[long])
    for s, e, q in found.tolist():
        if not np.array_equal(ids[s : e - q], ids[s + q : e]) or (s and ids[s - 1] == ids[s - 1 + q]) or (e < len(ids) and ids[e] == ids[e - q]):
            raise ValueError("hashes of unlike words agree")
    return found


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words; of a tenth of the documents, picked by the CRC-32 of the id, the words from some place on repeat a piece of themselves."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    piece = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (piece * (-(-(n - a) // len(piece))))[: n - a]


def _described(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of SCHEMA; runs are start, length, period."""
    best = None
    listing, keep = hashlib.sha256(), np.ones(len(words), bool)
    for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])):
        listing.update(b"%d,%d,%d\n" % (s, n, q))
        keep[s + q : s + n] = False
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    kept = words if best is None else [words[i] for i in np.flatnonzero(keep).tolist()]
    collapsed = hashlib.sha256(b" ".join(kept)).hexdigest()
    s, n, q = best or (None, None, None)
    return doc_id, len(words), len(runs), s, n, q, None if best is None else 1000 * n // q, listing.hexdigest(), collapsed


def describe_words(ids: list[int | None], texts: list[list[bytes]]) -> list[tuple]:
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    numbers: dict[bytes, int] = {}
    laid = np.empty(int(lengths.sum()) + len(order), np.int64)
    at = 0
    begins = []
    for k, i in enumerate(order):
        n = len(texts[i])
        laid[at : at + n] = [numbers.setdefault(w, len(numbers)) for w in texts[i]]
        laid[at + n] = -1 - k
        begins.append(at)
        at += n + 1
    runs: dict[int, list[tuple[int, int, int]]] = {}
    found = find_runs(laid, lengths)
    long = found[:, 1] - found[:, 0] >= LEAST
    owner = np.searchsorted(np.array(begins), found[:, 0], side="right") - 1 if len(found) else found[:, 0]
    for k, (s, e, q) in zip(owner[long].tolist(), found[long].tolist()):
        runs.setdefault(order[k], []).append((s - begins[k], e - s, q))
    return [_described(ids[i], texts[i], runs.get(i, [])) for i in range(len(texts))]


def runs_of(docs: DataFrame, repeat_tails: bool = False) -> DataFrame:
    """A row per document: its runs, counted and digested, the one of most repeats, and the text without the repeats.

    A word is left out of the collapsed text if any run holds it after that run's first period. repeat_tails: see
    `with_tail`; it plants runs of long periods in a tenth of the documents.
    """
    kinds = dict(zip([f.split()[0] for f in SCHEMA.split(", ")], [f.split()[1] for f in SCHEMA.split(", ")]))
    arrow = {"long": pa.int64(), "string": pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(ids: list, texts: list) -> pa.RecordBatch:
            columns = list(zip(*describe_words(ids, texts)))
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds.values())], names=list(kinds))

        for batch in batches:
            ids, texts, total = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                ids.append(doc_id)
                texts.append(with_tail(words, doc_id) if repeat_tails else words)
                total += len(words) + 1
                if total >= BATCH:
                    yield batch_of(ids, texts)
                    ids, texts, total = [], [], 0
            if ids:
                yield batch_of(ids, texts)

    return docs.select(integer_id(docs, "doc_id"), "text").mapInArrow(rows, SCHEMA)
