"""Rolling hashes over UTF-8 bytes with numpy, so that no Python loop runs per word or per byte.

A span's hash is the polynomial sum of its bytes, taken from one running sum: the sum over the span,
shifted back by the inverse power of its start. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_sum(data: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] belongs to data[i:j]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def separators(letters_only: bool) -> np.ndarray:
    """Byte to byte, ASCII letters lowered; 0 parts words. letters_only: ASCII punctuation parts words too."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[:33] = 0
    table[127] = 0
    if letters_only:
        for i in range(33, 127):
            if not chr(i).isalnum():
                table[i] = 0
    return table


SPACED, ALNUM = separators(False), separators(True)


def pieces(texts: Iterable[bytes], parts: np.ndarray = SPACED, size: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches of about `size` bytes: document numbers and bytes. A longer text is cut between words."""
    numbers, held, total = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or (at == 0 and not text):
            end = min(len(text), at + size)
            if end < len(text):
                window = np.frombuffer(text, np.uint8, end - at, at)
                gaps = np.flatnonzero(parts[window] == 0)
                while not len(gaps) and end < len(text):
                    at_next = min(len(text), end + size)
                    gaps = np.flatnonzero(parts[np.frombuffer(text, np.uint8, at_next - end, end)] == 0) + (end - at)
                    end = at_next
                end = at + int(gaps[-1]) + 1 if len(gaps) and end < len(text) else end
            numbers.append(i)
            held.append(text[at:end])
            total += end - at
            at = end
            if total >= size:
                yield numbers, held
                numbers, held, total = [], [], 0
            if not text:
                break
    if numbers:
        yield numbers, held


def words(texts: Iterable[bytes], parts: np.ndarray = SPACED, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per batch, of each word in order: its document's number and its hash. Equal words, equal hashes.

    prefixes: after the words, the same for the first so many bytes of each longer word.
    """
    for numbers, held in pieces(texts, parts):
        buf = parts[np.frombuffer(b"\n".join(held), np.uint8)]
        edge = np.diff((buf != 0).astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        owner = np.asarray(numbers)[np.searchsorted(begins, start, side="right") - 1]
        sums = running_sum(buf)
        owners, hashes = [owner], [span_hash(sums, start, end)]
        for n in prefixes:
            longer = end - start > n
            owners.append(owner[longer])
            hashes.append(span_hash(sums, start[longer], start[longer] + n) ^ np.uint64(n * BASE % (1 << 64)))
        yield np.concatenate(owners), np.concatenate(hashes)


def words_by_text(texts: list[bytes], parts: np.ndarray = SPACED) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and its words' hashes, whole, in order."""
    held: list[np.ndarray] = []
    at = 0
    for owner, hashes in words(texts, parts):
        cuts = np.searchsorted(owner, np.arange(at, (owner[-1] if len(owner) else at) + 2))
        last = owner[-1] if len(owner) else at
        for k, i in enumerate(range(at, last)):
            yield i, np.concatenate([*held, hashes[cuts[k] : cuts[k + 1]]])
            held = []
        held.append(hashes[cuts[last - at] :])
        at = int(last)
    for i in range(at, len(texts)):
        yield i, np.concatenate(held) if held else np.zeros(0, np.uint64)
        held = []
