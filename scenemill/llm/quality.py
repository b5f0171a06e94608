"""Quality scores learned from preference pairs (Bradley-Terry).

A document's worth is w . x over the features below; the chance that one is preferred to another is the
logistic function of the difference of their worths. Pairs are a document labelled 1 and one labelled
0, PAIRS to each of the rarer label, drawn with a fixed seed from the bounded sample of labelled rows;
w minimises the logistic loss on feature differences plus a small ridge, by Newton's method. The cut is
that quantile of the sample's worths at which the two labels are told apart best (the mean of the two
labels' error rates is least), and a score is the logistic function of the distance from it, so 0.5 and
more means label 1.

Features cover the whole text: lengths, shares of capitals, digits, punctuation and odd symbols, of
distinct words, of the commonest word, of words that repeat the last one. No id, label, language or
source is among them. Null texts are empty. Where either label is missing from the sample nothing can be
learned, and every document scores 1. Repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bytehash import SPACED, words_by_text
from .sampling import SAMPLE, held_out, labelled_sample

PAIRS, RIDGE, SEED = 40, 1e-3, 7
# byte classes: 1 lower-case ASCII, 2 upper-case ASCII, 3 digits, 4 common punctuation, 5 other ASCII symbols, 6 white space, 7 the rest
_class = np.full(256, 7, np.uint8)
_class[:33] = 6
_class[33:128] = 5
_class[ord("a") : ord("z") + 1] = 1
_class[ord("A") : ord("Z") + 1] = 2
_class[ord("0") : ord("9") + 1] = 3
for _c in b".,;:'\"()-?":
    _class[_c] = 4


def features(texts: list[bytes]) -> np.ndarray:
    rows = []
    for i, w in words_by_text(texts, SPACED):
        text = texts[i]
        counts = np.zeros(8)
        for at in range(0, len(text), 1 << 20):
            counts += np.bincount(_class[np.frombuffer(text, np.uint8, min(1 << 20, len(text) - at), at)], minlength=8)
        n, k = max(1, len(text)), max(1, len(w))
        times = np.unique(w, return_counts=True)[1] if len(w) else np.ones(1)
        shares = [counts[2] / n, counts[3] / n, counts[4] / n, counts[5] / n, len(times) / k, times.max() / k, (w[1:] == w[:-1]).sum() / k, text.count(b"\n") / n]
        letters = max(1, counts[1] + counts[2] + counts[7])
        rows.append([np.log1p(n), np.log1p(k), len(text) / k, counts[2] / letters, *shares, *np.sqrt(shares)])
    return np.array(rows).reshape(-1, 20)


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    cut: float
    spread: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.worth(x) - self.cut) / self.spread, -30, 30)))


def learn(x: np.ndarray, label: np.ndarray) -> Model | None:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - centre) / scale, -8, 8)
    draw = np.random.default_rng(SEED)
    few, many = sorted((good, bad), key=len)
    one, other = np.repeat(few, PAIRS), draw.choice(many, len(few) * PAIRS)
    d = (z[one] - z[other]) * (1 if few is good else -1)
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w)), d.T @ p / len(d) - RIDGE * w)
        w += step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ w
    order = np.argsort(worth, kind="stable")
    is_bad = label[order] == 0
    errors = (1 - np.cumsum(is_bad) / len(bad)) + np.cumsum(~is_bad) / len(good)
    k = int(np.argmin(errors[:-1])) if len(order) > 1 else 0
    cut = (worth[order[k]] + worth[order[min(k + 1, len(order) - 1)]]) / 2
    return Model(w, centre, scale, float(cut), float(worth.std() / 4 + 1e-9))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model | None:
    """Features are computed by tasks; the driver gets 21 numbers for each of at most `limit` rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t.encode() for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = labelled_sample(docs, labels, "quality", limit).mapInArrow(rows, "x array<double>, label int").toArrow()
    if not got.num_rows:
        return None
    x, label = np.array(got.column("x").to_pylist()), got.column("label").to_numpy()
    order = np.lexsort((label, *x.T))  # the tasks' order must not matter
    return learn(x[order], label[order])


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """Every row of docs with a column `name`, 0 to 1; docs must not have one of that name."""
    fields = docs.columns

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(fields.index("text")).to_pylist()
            value = np.ones(len(text)) if model is None else model.score(features([(t or "").encode() for t in text])) if text else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*fields, name])

    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
