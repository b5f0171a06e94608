"""Benchmark decontamination: every training passage is a BM25 query against the test items.

Words are runs of letters and digits of the text in lower case. Items are dealt to classes by length: L is the
least power of two that is not below an item's words (MIN_WORDS at least). For each class documents are cut into
passages of 2L words, L apart, so each run of up to L words lies whole in some passage, and no item
changes the passages that another is looked for in. An item's score is its BM25 score for the passage's distinct words divided by its score
for its own, so 1 means every word of it is there; all items of at least `threshold` are retrieved.

Retrieval is block-max WAND over an inverted index whose lists are cut into blocks of BLOCK items.
First, for all passages of a document at once, numpy adds up per block the block maxima of the words that
few items hold and, for the words that many hold, the most that these can give any item of the block; for
the passages that pass it adds up the block maxima of all words. A sum below the threshold means that no
pivot exists in that block. Passages that pass for any block go through the pivot loop, which skips by list maxima, then by block maxima, and scores what is left. Bounds never lie below a score, so
nothing above the threshold is lost.

A retrieved item is then verified: at least `overlap` of its distinct five-word shingles, and of the
distinct words of its question and of its answer (its last sentences, as many as hold five words; if they
are the whole item, its last third) must stand in the passage. Items of under five words are one shingle.

One pass over the documents searches all classes of up to INDEX_BYTES of items, their indexes being sent to the tasks;
what a pass found is stored before the next one's indexes are built, so more items are more passes, not more
memory. Document frequencies are those of all items. item_id must be an integer or null. Null texts are empty, and no item or
document without words is ever matched. Repeated items and rows each count. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import ALNUM, mix, words_by_text
from .storage import integer_id, stored

K1, B = 1.2, 0.75
BLOCK, MIN_WORDS, COMMON, INDEX_BYTES, SHINGLE = 8, 32, 0.05, 16 << 20, 5
SLACK = 1e-9
_sentence = re.compile(r"(?<=[.!?\n])\s+")


def shingles(w: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of each n words in a row; of fewer words, one of them all; of none, none."""
    n = min(n, len(w))
    if not n:
        return w
    h = w[: len(w) - n + 1]
    for k in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return h


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode()


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    parts = _sentence.split(text.strip())
    for k in range(len(parts) - 1, 0, -1):
        answer = " ".join(parts[k:])
        if len(answer.split()) >= SHINGLE:
            return " ".join(parts[:k]), answer
    held = text.split()
    cut = len(held) - max(1, len(held) // 3)
    return " ".join(held[:cut]), " ".join(held[cut:])


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    shingles: np.ndarray
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Index:
    """Postings by term (columns of `first`), items by number; scores are shares of the item's own."""

    items: list[Item]
    vocabulary: np.ndarray  # sorted hashes
    first: np.ndarray  # start of each term's postings
    item: np.ndarray
    share: np.ndarray
    top: np.ndarray  # of each term's list
    common: np.ndarray  # whether a term is held by many items
    block_first: np.ndarray  # start of each term's blocks
    block: np.ndarray
    block_top: np.ndarray
    rest: np.ndarray  # of each block, the most that common terms give an item
    span: int  # words from one passage to the next


def build(rows: list[tuple[int, str]], frequency: dict[int, int], total: int, mean: float, span: int) -> Index:
    texts = [plain(t) for _, t in rows]
    split = [halves(t) for _, t in rows]
    sides = [[np.unique(w) for _, w in words_by_text([plain(s[k]) for s in split], ALNUM)] for k in (0, 1)]
    items = [Item(rows[i][0], w, np.unique(shingles(w)), sides[0][i], sides[1][i]) for i, w in words_by_text(texts, ALNUM)]
    terms, owners, shares = [], [], []
    for i, it in enumerate(items):
        t, tf = np.unique(it.words, return_counts=True)
        if not len(t):
            continue
        df = np.array([frequency[int(x)] for x in t.astype(np.int64)])
        s = np.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(it.words) / mean))
        terms.append(t)
        owners.append(np.full(len(t), i))
        shares.append(s / s.sum())
    t, owner, share = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((terms, np.uint64), (owners, np.int64), (shares, float)))
    order = np.lexsort((owner, t))
    t, owner, share = t[order], owner[order], share[order]
    vocabulary, first, held = np.unique(t, return_index=True, return_counts=True)
    number = np.repeat(np.arange(len(vocabulary)), held)
    common = held > max(1, COMMON * len(items))
    rest_of = np.bincount(owner, share * common[number], len(items)) if len(items) else np.zeros(0)
    blocks = -(-len(items) // BLOCK)
    rest = np.array([rest_of[b * BLOCK : (b + 1) * BLOCK].max() for b in range(blocks)])
    key, at = np.unique(number * max(1, blocks) + owner // BLOCK, return_index=True)
    tops = np.maximum.reduceat(share, at) if len(at) else np.zeros(0)
    block_first = np.searchsorted(key // max(1, blocks), np.arange(len(vocabulary) + 1))
    top = np.maximum.reduceat(share, first) if len(first) else np.zeros(0)
    return Index(items, vocabulary, np.append(first, len(t)), owner, share, top, common, block_first, key % max(1, blocks), tops, rest, span)


def pivot_search(ix: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Block-max WAND: (item, score) of each item whose shares at `terms` add up to the threshold or more."""
    lists = [[int(ix.first[t]), int(ix.first[t + 1]), float(ix.top[t])] for t in terms]
    found = []
    while lists:
        lists.sort(key=lambda c: ix.item[c[0]])
        bound = 0.0
        for p, c in enumerate(lists):
            bound += c[2]
            if bound >= threshold - SLACK:
                break
        else:
            break
        pivot = int(ix.item[lists[p][0]])
        while p + 1 < len(lists) and ix.item[lists[p + 1][0]] == pivot:
            p += 1
        edge = (pivot // BLOCK + 1) * BLOCK
        bound = 0.0
        for c in lists[: p + 1]:
            low, high = (c[0] + int(np.searchsorted(ix.item[c[0] : c[1]], x)) for x in (edge - BLOCK, edge))
            bound += float(ix.share[low:high].max()) if high > low else 0.0
        if bound >= threshold - SLACK:
            if ix.item[lists[0][0]] == pivot:
                score = float(sum(ix.share[c[0]] for c in lists[: p + 1]))
                if score >= threshold - SLACK:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
        else:
            target = edge if p + 1 == len(lists) else min(edge, max(pivot + 1, int(ix.item[lists[p + 1][0]])))
        for c in lists[: p + 1]:
            c[0] += int(np.searchsorted(ix.item[c[0] : c[1]], target))
        lists = [c for c in lists if c[0] < c[1]]
    return found


def _share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole).mean()) if len(part) else 1.0


def _block_sums(ix: Index, passage: np.ndarray, term: np.ndarray, n_passages: int) -> np.ndarray:
    """Per passage and block, the sum of the terms' maxima in that block."""
    n, blocks = ix.block_first[term + 1] - ix.block_first[term], len(ix.rest)
    place = np.repeat(ix.block_first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.bincount(np.repeat(passage, n) * blocks + ix.block[place], ix.block_top[place], n_passages * blocks).reshape(-1, blocks)


def span_of(n_words: int) -> int:
    """The passage step of an item's class."""
    return max(MIN_WORDS, 1 << max(0, n_words - 1).bit_length())


@dataclass
class Classes:
    """The indexes of a pass, one for each class of items, and the vocabulary of them all."""

    indexes: list[Index]
    vocabulary: np.ndarray
    columns: list[np.ndarray]  # of each index, its column for each word of the vocabulary, or -1

    @staticmethod
    def of(rows: list[tuple[int, str]], frequency: dict[int, int], total: int, mean: float) -> Classes:
        by_span: dict[int, list] = {}
        for i, w in words_by_text([plain(t) for _, t in rows], ALNUM):
            by_span.setdefault(span_of(len(w)), []).append(rows[i])
        indexes = [build(held, frequency, total, mean, span) for span, held in sorted(by_span.items())]
        vocabulary = np.unique(np.concatenate([ix.vocabulary for ix in indexes])) if indexes else np.zeros(0, np.uint64)
        columns = [np.full(len(vocabulary), -1, np.int64) for _ in indexes]
        for column, ix in zip(columns, indexes):
            column[np.searchsorted(vocabulary, ix.vocabulary)] = np.arange(len(ix.vocabulary))
        return Classes(indexes, vocabulary, columns)

    def search(self, w: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int | None, list]]:
        """item_id of each verified item, with best score, shingle, question and answer overlap, passages."""
        if not len(w) or not len(self.vocabulary):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, w), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == w)
        for ix, column in zip(self.indexes, self.columns):
            term = column[at[known]]
            for i, found in search(ix, w, known[term >= 0], term[term >= 0], threshold, overlap).items():
                yield ix.items[i].item_id, found


def search(ix: Index, w: np.ndarray, known: np.ndarray, at: np.ndarray, threshold: float, overlap: float) -> dict[int, list]:
    """Per verified item, by number. known: where words of the index stand in w; at: their columns."""
    if not len(known):
        return {}
    last = max(0, -(-len(w) // ix.span) - 2)  # passage p holds words from p * span to (p + 2) * span
    step, wide = known // ix.span, len(ix.vocabulary)
    pairs = np.concatenate([(np.minimum(step, last)) * wide + at, (np.minimum(np.maximum(step - 1, 0), last)) * wide + at])
    rare = np.unique(pairs[~ix.common[pairs % wide]])
    passage, term = rare // wide, rare % wide
    bound = _block_sums(ix, passage, term, last + 1)
    hits: dict[int, list] = {}
    pairs = np.sort(pairs)
    for p in np.flatnonzero((bound + ix.rest >= threshold - SLACK).any(axis=1)):
        here = np.unique(pairs[np.searchsorted(pairs, p * wide) : np.searchsorted(pairs, (p + 1) * wide)]) % wide
        if not (_block_sums(ix, np.zeros(len(here), np.int64), here, 1) >= threshold - SLACK).any():
            continue
        found = pivot_search(ix, here, threshold)
        if not found:
            continue
        text = w[p * ix.span : (p + 2) * ix.span]
        grams = {n: shingles(text, n) for n in {min(SHINGLE, len(ix.items[i].words)) for i, _ in found}}
        for i, score in found:
            it = ix.items[i]
            shared = [_share(it.shingles, grams[min(SHINGLE, len(it.words))]), _share(it.question, text), _share(it.answer, text)]
            if min(shared) >= overlap:
                best = hits.get(i)
                if best is None or [score, *shared] > best[:4]:
                    hits[i] = [score, *shared, 0 if best is None else best[4]]
                hits[i][4] += 1
    return hits


def _term_rows(items: DataFrame) -> DataFrame:
    """item's words, with their distinct terms, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in words_by_text([plain(t) for t in batch.column(0).to_pylist()], ALNUM):
                t = np.unique(w).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), len(w)))], names=["term", "n_words"])

    return items.select("text").mapInArrow(rows, "term long, n_words long")


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.8) -> DataFrame:
    """A row per document and test item that it holds: doc_id, item_id, score, shingle_overlap, question_overlap, answer_overlap, n_passages."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, shingle_overlap double, question_overlap double, answer_overlap double, n_passages long"
    found = None
    for classes, more in passes(items):
        here = docs.select("doc_id", "text").mapInArrow(_searcher(classes, threshold, overlap), schema)
        here = stored(here, "leaks") if more or found is not None else here
        found = here if found is None else found.unionByName(here)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.8) -> DataFrame:
    """The rows of docs that hold no test item."""
    for classes, more in passes(items):
        docs = docs.mapInArrow(_sieve(classes, docs.columns.index("text"), threshold, overlap), docs.schema)
        docs = stored(docs, "sieved") if more else docs
    return docs


def passes(items: DataFrame) -> Iterator[tuple[Classes, bool]]:
    """The indexes of each pass, and whether another follows; those of one pass only are on the driver at a time."""
    items = items.where(F.col("text").isNotNull()).select(integer_id(items, "item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_passes = max(1, -(-size // INDEX_BYTES))
    items = stored(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_passes)).cast("int")), "items")
    total = items.count()
    frequencies = stored(_term_rows(items).groupBy("term").agg(F.count("*").alias("df")), "item-terms")
    mean = _lengths(items).agg(F.coalesce(F.avg("n"), F.lit(1.0))).first()[0]
    for part in range(n_passes):
        block = items.where(F.col("part") == part)  # of about INDEX_BYTES of text
        rows = sorted((r["item_id"] is None, r["item_id"] or 0, r["text"]) for r in block.collect())
        known = _term_rows(block).select("term").distinct()
        df = {r["term"]: r["df"] for r in frequencies.join(known, "term").collect()}
        yield Classes.of([(None if none else i, t) for none, i, t in rows], df, total, max(1.0, mean)), part + 1 < n_passes


def _lengths(items: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for _, w in words_by_text([plain(t) for t in batch.column(0).to_pylist()], ALNUM)], pa.int64())], names=["n"])

    return items.select("text").mapInArrow(rows, "n long")


def _searcher(classes: Classes, threshold: float, overlap: float):
    names = ["doc_id", "item_id", "score", "shingle_overlap", "question_overlap", "answer_overlap", "n_passages"]
    types = [None, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [plain(t) for t in part.column(1).to_pylist()]
                found = [(i, k, *v) for i, w in words_by_text(texts, ALNUM) for k, v in classes.search(w, threshold, overlap)]
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0])), *[pa.array(c, t) for c, t in zip(columns[1:], types[1:])]], names=names)

    return rows


def _sieve(classes: Classes, where: int, threshold: float, overlap: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [plain(t) for t in part.column(where).to_pylist()]
                yield part.filter(pa.array([next(classes.search(w, threshold, overlap), None) is None for _, w in words_by_text(texts, ALNUM)], pa.bool_()))

    return rows
