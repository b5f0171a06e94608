"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are cut into pre-tokens ("words") by the tokenizer's pattern. A block is some documents of one task, of
about BLOCK characters or MAX_WORDS distinct words. In it each distinct word gets a number, by falling
frequency, and the texts become those numbers in order: where each word stands is kept as this packed
list of positions. The distinct words of all blocks are shuffled by word. Each is encoded once, by merging
the pair of least rank until none is left, and its ids go back to every block that has it. There the ids
are joined in, position by position. Decoding joins the token-byte table: ids are looked up in it and the
bytes put in a row.

Cutting. WORD_PATTERN looks at classes of characters only (letters, numbers, white space, the rest), so it is
worked out for a piece of about PIECE characters at once with numpy, the classes being asked of the regular
expression library itself. Equal words of a piece are found by a hash, and compared byte by byte. Any other
pattern is run as a regular expression over each text.

A very common word costs a row per block, not one per occurrence. Words and positions come from two passes
over the documents: keeping the positions of one pass would need another half of the input in disk. A block is named by the
digest of its numbered words, which must equal that of the words decoded from their ids: if the passes met other
rows (a source that changed meanwhile) the job fails and cannot go wrong in silence.

The ranks, a fixed file, go to every task; the driver opens the file, and it is never copied elsewhere.

Null texts are empty, and empty texts have no tokens. No special tokens are read or made. Repeated rows
give repeated results; other columns are not read. doc_id must be an integer or null. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import running_sum, span_hash
from .storage import integer_id

BLOCK, MAX_WORDS, CHUNK, PIECE, ROWS, SHORT = 32 << 20, 800_000, 256, 1 << 20, 60_000, 48
# fixed value: the pattern of the public byte-level vocabularies
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = range(4)
NEVER = np.int32(2**31 - 1)
# before white space or a change of letters and numbers a text can be cut: no word crosses it, and none looks back over it
_cut_here = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=[^\p{N}])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, of any length: pairs wait in a heap by rank and place."""
    if word in ranks:
        return [ranks[word]]
    part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    waiting = [(r, i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, whole = heapq.heappop(waiting)
        j = after[i] if part[i] is not None else len(part)
        if j == len(part) or len(part[i]) + len(part[j]) != len(whole) or part[i] + part[j] != whole:
            continue
        part[i], part[j] = whole, None
        after[i] = after[j]
        if after[i] < len(part):
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(part) and (r := ranks.get(part[left] + part[right])) is not None:
                heapq.heappush(waiting, (r, left, part[left] + part[right]))
    return [ranks[p] for p in part if p is not None]


class Merger:
    """The ids of many words at once. A row of a matrix is a word; in each round every row merges its pair of least rank, the
    first among equals, and so loses a cell."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.wide = max(ranks.values()) + 2
        pairs = sorted((ranks[t[:k]] * self.wide + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs, self.made = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((-1,), (0,))))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER where it makes no token (a cell without token is -1)."""
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.made[at], NEVER).astype(np.int32)

    def _matrix(self, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their final cells) of words in rows, until all are given."""
        row, pair = np.arange(len(cells)), self.joined(cells[:, :-1], cells[:, 1:])
        while len(row):
            if not pair.shape[1]:
                yield row, cells
                return
            at = pair.argmin(axis=1)
            least = pair[np.arange(len(row)), at]
            over = least == NEVER
            if over.any():
                yield row[over], cells[over]
                live = ~over
                row, cells, pair, at, least = row[live], cells[live], pair[live], at[live], least[live]
                if not len(row):
                    return
            n, i = len(row), np.arange(len(row))
            cells[i, at] = least
            keep = np.ones(cells.shape, bool)
            keep[i, at + 1] = False
            cells = cells[keep].reshape(n, -1)
            pair = pair[keep[:, 1:]].reshape(n, -1)  # the pair that was merged is cell at + 1's
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < pair.shape[1])
            pair[left, at[left] - 1] = self.joined(cells[left, at[left] - 1], cells[left, at[left]])
            pair[right, at[right]] = self.joined(cells[right, at[right]], cells[right, at[right] + 1])

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Of each word its ids, four bytes each."""
        out: list[bytes | None] = [None] * len(words)
        known, groups = self.ranks.get, {}
        for i, w in enumerate(words):
            r = known(w)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > SHORT:
                out[i] = np.array(merge(w, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault(-(-len(w) // 6), []).append(i)
        for step, members in groups.items():
            held = [words[i] for i in members]
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            cells = np.full((len(held), step * 6), -1, np.int32)
            cells[np.arange(step * 6) < sizes[:, None]] = self.single[np.frombuffer(b"".join(held), np.uint8)]
            for rows, ids in self._matrix(cells):
                count, flat = (ids >= 0).sum(axis=1), ids.astype("<u4")
                for k, n, line in zip(rows.tolist(), (count * 4).tolist(), flat):
                    out[members[k]] = line.tobytes()[:n]
        return out


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    text = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def word_starts(point: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Whether a word of WORD_PATTERN starts at each code point of texts in a row; opens: the first code points of texts that are not empty."""
    kind = _classes()[point]
    first = np.zeros(len(point) + 4, bool)  # the end of all counts as the first of another text
    first[opens] = True
    first[len(point) :] = True
    start = first[: len(point)].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last of some white space before another character stands alone, or, being a plain space, goes with that
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1 : len(point)])
    start[last] = True
    start[last[point[last] == 32] + 1] = False
    # short forms, where an apostrophe starts a word
    quote = np.flatnonzero((point == 39) & start)
    if len(quote):
        c = np.append(point, np.zeros(3, point.dtype))
        one, two = c[quote + 1], c[quote + 2]
        here = ~first[quote + 1]
        brief = here & ((one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d")))
        longer = here & ~first[quote + 2] & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        start = np.append(start, np.ones(4, bool))
        start[quote[brief | longer] + 1] = False
        start[quote[brief] + 2] = True
        start[quote[longer] + 3] = True
        start = start[: len(point)]
    return start


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether data[a : a + size] equals data[b : b + size] throughout."""
    longest = int(size.max(initial=0))
    rows = np.flatnonzero(a != b)
    a, b, size = a[rows], b[rows], size[rows]
    for k in range(min(longest, 64)):
        live = np.flatnonzero(size > k)
        if len(live) < len(size):
            a, b, size = a[live], b[live], size[live]
        if not np.array_equal(data[a + k], data[b + k]):
            return False
    return all(np.array_equal(data[i : i + n], data[j : j + n]) for i, j, n in zip(a.tolist(), b.tolist(), size.tolist()) if n > 64)


def cut_by_class(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, which of them stand in a row, and how many in each text. By WORD_PATTERN."""
    whole = "".join(texts)
    point = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(n)
    at = np.flatnonzero(word_starts(point, (ends - n)[n > 0])) if len(point) else np.zeros(0, np.int64)
    sizes = np.diff(np.searchsorted(at, ends), prepend=0)
    raw = whole.encode()
    data = np.frombuffer(raw, np.uint8)
    if len(data) > len(point):
        width = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        at = (np.cumsum(width) - width)[at]
    stop = np.append(at[1:], len(data)) if len(at) else at
    code, hashed = pd.factorize(span_hash(running_sum(data), at, stop))
    first = np.zeros(len(hashed), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    length = stop - at
    if not (np.array_equal(length[first][code], length) and _equal_bytes(data, at[first][code], at, length)):
        code, _ = pd.factorize(np.array([raw[a:b] for a, b in zip(at.tolist(), stop.tolist())], object))  # unlike words of one hash
        first = np.zeros(int(code.max()) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
    words = [raw[a:b] for a, b in zip(at[first].tolist(), stop[first].tolist())]
    return words, code, sizes


def cut_by_pattern(texts: list[str], pattern: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As cut_by_class, by any pattern."""
    number: dict[str, int] = {}
    rows = [[number.setdefault(w, len(number)) for w in _pattern(pattern).findall(t)] for t in texts]
    return [w.encode() for w in number], np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows], np.int64)


@lru_cache(1)
def _pattern(text: str) -> regex.Pattern:
    return regex.compile(text)


class Words:
    """The distinct words of a block's texts, numbered by falling frequency, then by word."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.number = pattern, {}
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held: list[str] = []
        self.joins: list[bool] = []
        self.length = 0

    def add(self, text: str) -> None:
        """Texts wait until they make a piece; a long one goes in parts, cut where no word crosses."""
        at = 0
        while self.pattern == WORD_PATTERN and self.length + len(text) - at > 2 * PIECE:
            gap = _cut_here.search(text, at + PIECE)
            if gap is None:
                break
            self._hold(text[at : gap.start()], at > 0)
            at = gap.start()
        self._hold(text[at:], at > 0)

    def _hold(self, part: str, joins: bool) -> None:
        self.held.append(part)
        self.joins.append(joins)
        self.length += len(part)
        if self.length >= PIECE:
            self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        words, code, sizes = cut_by_class(self.held) if self.pattern == WORD_PATTERN else cut_by_pattern(self.held, self.pattern)
        number = self.number
        mine = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
        self.codes.append(mine[code])
        begins = np.flatnonzero(~np.array(self.joins))
        if self.joins[0]:  # more of the text before
            head = sizes[: begins[0]].sum() if len(begins) else sizes.sum()
            self.sizes[-1][-1] += head
        if len(begins):
            self.sizes.append(np.add.reduceat(sizes, begins))
        self.held, self.joins, self.length = [], [], 0

    def close(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in order of their numbers, all texts' word numbers in a row, and how many each text has."""
        self.cut()
        code = np.concatenate(self.codes)
        held = list(self.number)
        # ties by word: likeness of neighbours is what the shuffle's compression lives on
        order = _by_count_and_word(np.bincount(code, minlength=len(held)), held)
        rank = np.empty(len(held), np.uint32)
        rank[order] = np.arange(len(held))
        return [held[i] for i in order.tolist()], rank[code], np.concatenate(self.sizes)


def _by_count_and_word(count: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Indices by falling count, then by word: by its first 16 bytes with numpy, the rest of equal ones in Python."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    at = np.cumsum(size) - size
    head = data[at[:, None] + np.arange(16)] * (np.arange(16) < size[:, None]).astype(np.uint8)
    keys = np.ascontiguousarray(head).view(">u8").astype(np.uint64)
    order = np.lexsort((keys[:, 1], keys[:, 0], -count)) if len(words) else np.zeros(0, np.int64)
    same = (keys[order][1:] == keys[order][:-1]).all(axis=1) & (count[order][1:] == count[order][:-1])
    edges = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        order[a : b + 1] = sorted(order[a : b + 1].tolist(), key=words.__getitem__)
    return order


def _digest(sizes: np.ndarray, data: bytes) -> int:
    digest = hashlib.blake2b(sizes.astype("<u4").tobytes(), digest_size=8)
    digest.update(data)
    return int.from_bytes(digest.digest(), "big", signed=True)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, list[bytes], list, np.ndarray, np.ndarray]]:
    """(digest of the words, words in order of their numbers, doc_ids, word numbers in a row, how many of each document) of each block."""

    def close():
        ordered, numbers, sizes = words.close()
        return _digest(np.fromiter(map(len, ordered), np.int64, len(ordered)), b"".join(ordered)), ordered, ids, numbers, sizes

    words, size, ids = Words(pattern), 0, []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            words.add(text or "")
            size += len(text or "")
            if size >= BLOCK or len(words.number) >= MAX_WORDS:
                yield close()
                words, size, ids = Words(pattern), 0, []
    if ids:
        yield close()


def pack(numbers: np.ndarray) -> bytes:
    """Low bytes, then high ones, compressed: most numbers are small."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 3)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


LAST = (1 << 31) - 1  # the place after all of a block's words


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """block (the digest of its words), number, word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, *_ in _blocks(batches, pattern):
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part, pa.binary())], names=["block", "number", "word"])

    return docs.select("doc_id", "text").mapInArrow(rows, "block long, number int, word binary")


def positions(docs: DataFrame, pattern: str) -> DataFrame:
    """block, number (LAST), body: some documents of a block a row, their ids, sizes and word numbers packed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, ids, numbers, sizes in _blocks(batches, pattern):
            ends = np.append(0, np.cumsum(sizes))
            for at in range(0, len(ids), CHUNK):
                here, n = ids[at : at + CHUNK], sizes[at : at + CHUNK]
                known = np.array([i is not None for i in here])
                head = [np.array([len(here)], "<i4"), np.array([i or 0 for i in here], "<i8"), known, n.astype("<i8")]
                body = b"".join(x.tobytes() for x in head) + pack(numbers[ends[at] : ends[at + len(here)]])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([LAST], pa.int32()), pa.array([body], pa.binary())], names=["block", "number", "body"])

    return docs.select(integer_id(docs, "doc_id"), "text").mapInArrow(rows, "block long, number int, body binary")


def _unpacked(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, sizes and word numbers of some documents."""
    n = int(np.frombuffer(body, "<i4", 1)[0])
    ids, known, sizes = np.frombuffer(body, "<i8", n, 4), np.frombuffer(body, "?", n, 4 + 8 * n), np.frombuffer(body, "<i8", n, 4 + 9 * n)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], sizes, unpack(body[4 + 17 * n :])


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """block, number, body: the ids of each word (four bytes each), found once for each distinct word."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)  # the fixed table of the tokenizer

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, last = Merger(shared.value), (None, b"")
        for batch in _gathered(batches):
            coded = batch.column(2).dictionary_encode()
            fresh = coded.dictionary.to_pylist()
            again = fresh[0] == last[0]  # words come sorted
            ids = [last[1]] * again + merger.encode(fresh[again:])
            last = fresh[-1], ids[-1]
            body = pa.array(ids, pa.binary()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], names=["block", "number", "body"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(rows, "block long, number int, body binary")


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Table:
    """A string for each id, looked up for many ids at once."""

    def __init__(self, strings: dict[int, bytes]) -> None:
        self.size = np.zeros(max(strings) + 1, np.int64)
        self.size[list(strings)] = [len(s) for s in strings.values()]
        self.start = np.zeros(len(self.size), np.int64)
        self.start[list(strings)] = np.cumsum([len(s) for s in strings.values()]) - [len(s) for s in strings.values()]
        self.data = np.frombuffer(b"".join(strings.values()), np.uint8)

    def rows(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, bytes]:
        """How long the strings of each `count` ids in a row are, and all of them in a row."""
        n = self.size[ids]
        ends = np.append(0, np.cumsum(n))
        place = np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], n)
        return np.diff(ends[np.append(0, np.cumsum(count))]), self.data[place].tobytes()


def _split(sizes: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, strings: Table | None, make, schema: str) -> DataFrame:
    """Encode every text. make(doc_ids, counts, named, decoded, orders) gives the columns of `schema` for some documents: counts, named and
    decoded say of each word of a block how many ids it has, what stands for them by `strings` (the ids themselves
    if None), and the bytes they decode to; orders are the word numbers of each document in order."""
    shared = docs.sparkSession.sparkContext.broadcast((Table({i: t for t, i in ranks.items()}), strings))  # fixed as well
    both = encode_words(distinct_words(docs, pattern), ranks).unionByName(positions(docs, pattern))

    def closed(block: int, parts: list[tuple]) -> tuple:
        """(counts, named, decoded) of a block's words."""
        tokens, names = shared.value
        number, count, ids = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        fresh = np.append(True, number[1:] != number[:-1])[: len(number)]  # the rest are of an equal block
        ids, number, count = ids[np.repeat(fresh, count)], number[fresh], count[fresh]
        sizes, data = tokens.rows(ids, count)
        if not np.array_equal(number, np.arange(len(number))) or _digest(sizes, data) != block:
            raise ValueError(f"block {block}: its words are not those that its documents were numbered by")
        named = _split(count * 4, ids.astype("<u4").tobytes()) if names is None else _split(*names.rows(ids, count))
        return count, named, _split(sizes, data)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, open_blocks = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            block, number, body = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            edges = np.flatnonzero((block[1:] != block[:-1]) | (number[1:] == LAST) | (number[:-1] == LAST)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                here = int(block[a])
                if here & 0xFFFFFFFF != high:  # blocks alike in these bits come mixed
                    high, open_blocks = here & 0xFFFFFFFF, {}
                parts, ready = open_blocks.setdefault(here, ([], []))
                if number[a] != LAST:
                    words = body.slice(a, b - a).to_pylist()
                    parts.append((number[a:b].astype(np.int64), np.fromiter(map(len, words), np.int64, b - a) // 4, np.frombuffer(b"".join(words), "<u4").astype(np.int64)))
                    continue
                if not ready:
                    ready.extend(closed(here, parts))
                    parts.clear()
                ids, sizes, order = _unpacked(body[a].as_py())
                yield make(ids, *ready, np.split(order, np.cumsum(sizes)[:-1]))

    # one key of 64 bits, which Spark sorts by radix
    slot = F.shiftleft("block", 32).bitwiseOR(F.col("number").cast("long"))
    return both.repartition("block").withColumn("slot", slot).sortWithinPartitions("slot").mapInArrow(rows, schema)


def _joined(column: list[bytes], order: np.ndarray) -> bytes:
    return b"".join(itemgetter(*order.tolist())(column)) if len(order) > 1 else b"".join(column[i] for i in order.tolist())


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def make(ids, counts, named, decoded, orders):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([int(counts[x].sum()) for x in orders], pa.int64()),
                pa.array([hashlib.sha256(_joined(named, x)[1:]).hexdigest() for x in orders]),
                pa.array([hashlib.sha256(_joined(decoded, x)).hexdigest() for x in orders]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    strings = Table({i: f" {i}".encode() for i in ranks.values()})
    return encode(docs, ranks, pattern, strings, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every row."""

    def make(ids, counts, named, decoded, orders):
        flat = [np.frombuffer(_joined(named, x), "<i4") for x in orders]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(x) for x in flat], pa.int64()), pa.array(flat, pa.list_(pa.int32())),
                pa.array([hashlib.sha256(_joined(decoded, x)).hexdigest() for x in orders]),
            ],
            names=["doc_id", "n_tokens", "ids", "decoded_sha256"],
        )

    return encode(docs, ranks, pattern, None, make, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
