"""Toxicity by a factorization machine over hashed terms.

A term is a run of letters and digits of the text in lower case, or its first 3 to 7 bytes if it is longer, so that
inflected forms share terms; each is hashed to one of 2**18 bins. A second and a third occurrence in a
document are terms of their own. The terms that tell the
labels apart best in the sample (by chi-square, TERMS at most, in MIN_DOCS documents at least) get a
weight and a vector of RANK numbers each. A document's logit is the bias, plus the weights of the terms
it holds, plus the dot products of the vectors of every two of them. So two terms that are harmless
apart, as an insult and a group's name, can count together, which no sum of single weights can say. The
sum over pairs is half of the squared sum less the sum of squares, linear in the terms. All are learned
by Adam on the logistic loss from the bounded sample of labelled rows, with a fixed seed.

Scores cover whole texts. Null texts are empty and hold no term. Where either label is missing from the
sample nothing can be learned, and every document scores 0. Repeated rows get equal scores; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import ALNUM, words
from .sampling import SAMPLE, held_out, labelled_sample
from .storage import stored

BITS, TERMS, MIN_DOCS, RANK = 18, 512, 5, 8
PREFIXES = (3, 4, 5, 6, 7)
LEVELS, SPACE = 3, 1 << (BITS + 2)
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 256, 0.02, 1e-4, 11


def terms(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document number and term of each distinct pair, sorted. known: per bin, whether any term of it counts."""
    found = [np.zeros(0, np.int64)]
    for owner, hashes in words(texts, ALNUM, PREFIXES):
        bins = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        if known is not None:
            owner, bins = owner[known[bins]], bins[known[bins]]
        found.append((owner.astype(np.int64) << BITS) | bins)
    pairs, times = np.unique(np.concatenate(found), return_counts=True)
    ids = np.sort(np.concatenate([(pairs[times > k] << 2) | k for k in range(LEVELS)]))
    return ids >> (BITS + 2), ids & (SPACE - 1)


@dataclass
class Model:
    column: np.ndarray  # term to column or -1
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, term = terms(texts, (self.column >= 0).reshape(-1, 4).any(axis=1))
        kept = self.column[term] >= 0
        doc, col, n = doc[kept], self.column[term[kept]], len(texts)
        total = self.bias + np.bincount(doc, self.weight[col], n)
        for v in self.vector.T:
            total += 0.5 * (np.bincount(doc, v[col], n) ** 2 - np.bincount(doc, v[col] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _chi(present, both, toxic: int, n: int):
    """How well a term that `present` documents hold, `both` of them toxic, tells the labels apart; numbers or columns."""
    expected = present * toxic / n
    spread = expected * (1 - toxic / n) * (1 - present / n)
    floor = F.greatest(spread, F.lit(1e-9)) if isinstance(present, Column) else np.maximum(spread, 1e-9)
    return (both - expected) * (both - expected) / floor


def learn(doc: np.ndarray, held: np.ndarray, label: np.ndarray, best: np.ndarray) -> Model | None:
    """doc, held: the document and the term of each pair; best: the sorted terms to learn from."""
    n, toxic = len(label), int(label.sum())
    if not 0 < toxic < n:
        return None
    column = np.full(SPACE, -1, np.int32)
    column[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.float32)
    kept = column[held] >= 0
    x[doc[kept], column[held[kept]]] = 1
    draw = np.random.default_rng(SEED)
    p = [np.array([np.log(toxic / (n - toxic))]), np.zeros(len(best)), draw.normal(0, 0.01, (len(best), RANK))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = draw.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            xb = x[rows]
            s = xb @ p[2]
            logit = p[0] + xb @ p[1] + 0.5 * ((s**2).sum(axis=1) - xb @ (p[2] ** 2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[rows]) / len(rows)
            grads = [np.array([g.sum()]), xb.T @ g + DECAY * p[1], xb.T @ (g[:, None] * s) - (xb.T @ g)[:, None] * p[2] + DECAY * p[2]]
            step += 1
            for a, da, ma, va in zip(p, grads, m, v):
                ma += 0.1 * (da - ma)
                va += 0.001 * (da**2 - va)
                a -= RATE * (ma / (1 - 0.9**step)) / (np.sqrt(va / (1 - 0.999**step)) + 1e-8)
    return Model(column, float(p[0][0]), p[1], p[2])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model | None:
    """Terms are found, counted and chosen by tasks; the driver gets the TERMS best and which of them each of at most `limit` texts holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                texts = [t.lower().encode() for t in part.column(0).to_pylist()]
                doc, bins = terms(texts)
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                packed = [bins[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), part.column(1)], names=["bins", "label"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.frombuffer(b, "<i4") for b in batch.column(0).to_pylist()]
            if bins:
                term, at = np.unique(np.concatenate(bins), return_inverse=True)
                toxic = np.repeat(batch.column(1).to_numpy(), [len(b) for b in bins])
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(np.bincount(at)), pa.array(np.bincount(at, toxic).astype(np.int64))], names=["term", "n", "toxic"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.intersect1d(np.frombuffer(b, "<i4"), best, assume_unique=True).astype("<i4").tobytes() for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), batch.column(1)], names=["bins", "label"])

    sample = stored(labelled_sample(docs, labels, "toxic", limit).mapInArrow(rows, "bins binary, label int"), "terms")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return None
    counts = sample.mapInArrow(counted, "term int, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_DOCS)
    chosen = counts.withColumn("chi", _chi(F.col("n").cast("double"), F.col("toxic"), toxic, n)).where("chi > 0").orderBy(F.desc("chi"), "term").limit(TERMS)
    best = np.sort(np.array([r["term"] for r in chosen.select("term").collect()], np.int32))
    got = sample.mapInArrow(kept, "bins binary, label int").toArrow()
    rows_held = sorted(zip(got.column("bins").to_pylist(), got.column("label").to_pylist()))  # the tasks' order must not matter
    held = [np.frombuffer(b, "<i4") for b, _ in rows_held]
    return learn(np.repeat(np.arange(len(held)), [len(b) for b in held]), np.concatenate(held), np.array([x for _, x in rows_held]), best)


def rated(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [(t or "").lower().encode() for t in batch.column(1).to_pylist()]
            value = np.zeros(len(text)) if model is None else model.score(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, score double")
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )
