"""Media columns: texts held as 8-bit WAV samples, short-time spectra, and peak-pair fingerprints.

The payload is the text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64. It is written by
the wave module as mono 8-bit samples, one byte a sample, into a binary column of a stored table; the
stored bytes are then read by the wave module again and everything else comes from those.

Spectra use frames of 64 samples, 32 apart, under a Hann window. A peak is a bin of the log power, in
whole decibels, above its neighbours in frequency and not below those in time, and above its frame's
mean by 6 dB. Each peak is paired with the next FAN peaks within SPAN frames; a pair is one long:
frame << 24 | bin << 16 | other bin << 8 | distance in frames, in order of time. Frames are taken in
blocks, so memory does not grow with a text.

A null text is empty: 64 bytes 0, no peaks. Equal texts give equal values. Repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import stored

UNIT, FRAME, HOP, RATE = 64, 64, 32, 8000
FAN, SPAN, BLOCK = 3, 32, 1 << 14
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def decibels(samples: np.ndarray) -> np.ndarray:
    """Whole decibels of power by frame and bin, constant offset removed."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP].astype(np.float32) - np.float32(128)
    frames -= frames.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(frames * WINDOW, axis=1)) ** 2
    return np.rint(10 * np.log10(1 + power)).astype(np.int16)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each peak, in order of time, then frequency."""
    total = (len(samples) - FRAME) // HOP + 1
    times, bins = [], []
    for first in range(0, total, BLOCK):
        low, high = max(0, first - 1), min(total, first + BLOCK + 1)
        db = decibels(samples[low * HOP : (high - 1) * HOP + FRAME])
        inner = db[:, 1:-1]
        top = (inner > db[:, :-2]) & (inner > db[:, 2:]) & (inner >= db.mean(axis=1, keepdims=True) + 6)
        top[1:] &= inner[1:] > inner[:-1]
        top[:-1] &= inner[:-1] >= inner[1:]
        t, f = np.nonzero(top)
        keep = (t + low >= first) & (t + low < first + BLOCK)
        times.append(t[keep] + low)
        bins.append(f[keep] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(payload: bytes) -> np.ndarray:
    t, f = peaks(np.frombuffer(payload, np.uint8))
    t, f = t.astype(np.int64), f.astype(np.int64)
    codes = []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= SPAN
        codes.append(((t[:-k] << 24) | (f[:-k] << 16) | (f[k:] << 8) | gap)[near])
    return np.sort(np.concatenate(codes))


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, as a stored table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                media = [to_wav(x + bytes(max(UNIT, -len(x) // UNIT * -UNIT) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Digests and fingerprints of a media table, from the stored bytes."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                stored_bytes = part.column(2).to_pylist()
                payload = [from_wav(x) for x in stored_bytes]
                prints = [fingerprints(x) for x in payload]
                columns = [
                    part.column(0), part.column(1), pa.array(map(len, payload), pa.int64()),
                    pa.array(hashlib.sha256(x).hexdigest() for x in payload),
                    pa.array((zlib.crc32(x[-UNIT:]) for x in payload), pa.int64()),
                    pa.array(map(len, stored_bytes), pa.int64()),
                    pa.array(hashlib.sha256(x).hexdigest() for x in stored_bytes),
                    pa.array(f"{len(x)}:{hashlib.sha256(x.astype('<i8').tobytes()).hexdigest()}" for x in prints),
                    pa.array(prints, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
    return media.mapInArrow(read, schema)
