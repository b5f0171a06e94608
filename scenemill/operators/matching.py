"""Greedy one-to-one matching of scored predictions to labels, and average precision.

In a group, predictions claim labels in order of falling score, ties in input order. Each takes the unclaimed
label of greatest overlap, the one of highest number among equals, and claims it if the overlap reaches
the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import as_oriented, sanitized
from ..functions.polygons import placed, shared_outlines, turned as turned_form
from .ranking import best_from_here, checkpointed, in_order, running


PAIRS = 1 << 20


def class_protocol(objects: DataFrame, rename: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rename labels (those without a new name go), then keep the listed ones. For both sides, before matching."""
    if rename is not None:
        if not rename:
            return objects.limit(0)
        names = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])
        objects = objects.withColumn("label", F.element_at(names, F.col("label"))).where(F.col("label").isNotNull())
    return objects if keep is None else objects.where(F.col("label").isin(list(keep)))


_AXES = ("x0", "y0", "z0", "x1", "y1", "z1")
_TURNED = "_form"


class _Side:
    """Boxes of one side of many groups: bounds, whether there is a box, and where some are oriented the corners and the volume of each."""

    def __init__(self, columns: dict[str, pa.Array]):
        self.bounds = np.column_stack([columns[c].to_numpy(zero_copy_only=False) for c in _AXES]).astype(float)
        self.there = columns["there"].to_numpy(zero_copy_only=False).astype(bool)
        self.turned = None
        if _TURNED in columns:
            self.turned = columns["turned"].to_numpy(zero_copy_only=False).astype(bool)
            self.corners, self.volume = placed(columns[_TURNED])


def _length(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x * 0.5 + np.abs(x) * 0.5)


def _first_max(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(b), a, np.maximum(a, b))


def overlaps(preds: _Side, labels: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Intersection over union of prediction i and label j, pair by pair, as `box_iou` has it."""
    p, q = preds.bounds[i], labels.bounds[j]
    shared, sizes = np.ones(len(i)), [np.ones(len(i)), np.ones(len(i))]
    for d in range(3):
        shared = shared * _length(-_first_max(-p[:, d + 3], -q[:, d + 3]) - _first_max(p[:, d], q[:, d]))
        sizes = [v * _length(x[:, d + 3] - x[:, d]) for v, x in zip(sizes, (p, q))]
    union = sizes[0] + sizes[1] - shared
    with np.errstate(all="ignore"):
        out = np.where(preds.there[i] & labels.there[j] & (union != 0), shared / union, 0.0)
    if preds.turned is not None:
        k = np.flatnonzero((preds.turned[i] | labels.turned[j]) & preds.there[i] & labels.there[j])
        a, b = preds.corners[i[k]], labels.corners[j[k]]
        near = ((a.max(axis=1) > b.min(axis=1)) & (b.max(axis=1) > a.min(axis=1))).all(axis=1)
        rise = np.minimum(a[:, :, 2].max(axis=1), b[:, :, 2].max(axis=1)) - np.maximum(a[:, :, 2].min(axis=1), b[:, :, 2].min(axis=1))
        area = np.zeros(len(k))
        area[near] = shared_outlines(a[near], b[near])
        shared = np.minimum(np.minimum(area * np.maximum(rise, 0.0), preds.volume[i[k]]), labels.volume[j[k]])
        union = preds.volume[i[k]] + labels.volume[j[k]] - shared
        out[k] = np.where(union > 0, shared / np.where(union > 0, union, 1.0), 0.0)
    return out


def claims(preds: _Side, labels: _Side, low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The label that each prediction claims (-1: none) and their overlap. Predictions come in order; low to high (not in it) are the labels of their group."""
    chosen, overlap = np.full(len(low), -1), np.zeros(len(low))
    taken = np.zeros(len(labels.there), bool)
    ends = np.cumsum(high - low)
    at = 0
    while at < len(low):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        counts = (high - low)[at:stop]
        i = np.repeat(np.arange(at, stop), counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + low[i]
        v = overlaps(preds, labels, i, j)
        fit = v >= threshold
        i, j, v = i[fit], j[fit], v[fit]
        order = np.lexsort((-j, -v, i))
        i, j, v = i[order], j[order], v[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(i)]):
            k = a if not taken[j[a]] else next((m for m in range(a + 1, min(b, a + 8)) if not taken[j[m]]), None)
            if k is None and b > a + 8:
                free = np.flatnonzero(~taken[j[a + 8 : b]])
                k = a + 8 + int(free[0]) if len(free) else None
            if k is not None:
                taken[j[k]] = True
                chosen[i[a]], overlap[i[a]] = j[k], v[k]
        at = stop
    return chosen, overlap


def _sided(df: DataFrame, by: list[str], side: int, turned: bool) -> DataFrame:
    """by, side, number, score, bounds of the box and, where one side has oriented boxes, its oriented form."""
    b = F.col("box")
    score = F.col("score").cast("double") if side else F.lit(None).cast("double")
    out = df.select(*by, F.lit(side).alias("side"), F.col("obj_idx").cast("int").alias("number"), score.alias("score"), b.isNotNull().alias("there"), *[b[c].cast("double").alias(c) for c in _AXES], *(["box"] if turned else []))
    if not turned:
        return out
    form = turned_form(out, "box")
    plain = sanitized(as_oriented(b))
    whole = plain if form is None else F.coalesce(form, plain)
    return out.select(*by, "side", "number", "score", "there", *_AXES, (F.lit(False) if form is None else form.isNotNull()).alias("turned"), F.when(F.col("there"), whole).alias(_TURNED))


def greedy_match(preds: DataFrame, labels: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, obj_idx, score, rank, gt_idx (null: unmatched), iou (of the claimed label, else 0) of every prediction.

    Both sides are dealt by group and stream by in order, labels first. Overlaps are worked out at most PAIRS at a time, for many
    small groups or a part of a crowded one, so no pair is ever a row. A group is a scene, or a label in a scene; its
    boxes, not its pairs, are held by one task. obj_idx must be unique in a group.
    """
    oriented = any(turned_form(df, "box") is not None for df in (preds, labels))
    both = _sided(labels, by, 0, oriented).unionByName(_sided(preds, by, 1, oriented))
    kinds = ", ".join(f"{k} {preds.schema[k].dataType.simpleString()}" for k in by)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def matched(table: pa.Table) -> pa.RecordBatch:
            """Of whole groups."""
            table = table.combine_chunks()
            columns = {c: table.column(c).chunk(0) for c in table.column_names}
            side = columns["side"].to_numpy()
            group = _numbers(table, by)
            is_label, is_pred = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            low, high = np.searchsorted(group[is_label], group[is_pred], side="left"), np.searchsorted(group[is_label], group[is_pred], side="right")
            pick = lambda at: _Side({c: columns[c].take(pa.array(at)) for c in columns if c not in by})
            chosen, overlap = claims(pick(is_pred), pick(is_label), low, high, threshold)
            rank = np.arange(len(is_pred)) - np.searchsorted(group[is_pred], group[is_pred], side="left") + 1
            number = columns["number"].to_numpy()
            label = pa.array(number[is_label][chosen] if len(is_label) else np.zeros(len(chosen), np.int32), pa.int32(), mask=chosen < 0)
            at = pa.array(is_pred)
            return pa.RecordBatch.from_arrays(
                [*(columns[k].take(at) for k in by), columns["number"].take(at), columns["score"].take(at), pa.array(rank, pa.int32()), label, pa.array(overlap)],
                names=[*by, "obj_idx", "score", "rank", "gt_idx", "iou"],
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            group = _numbers(held.slice(held.num_rows - batch.num_rows - (held.num_rows > batch.num_rows)), by)
            last = held.num_rows - int((group == group[-1]).sum()) if batch.num_rows else 0
            if group[0] != group[-1] and last > 0:  # the last group may go on in the next batch
                yield matched(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield matched(held)

    dealt = both.repartition(*by).sortWithinPartitions(*by, "side", F.desc("score"), "number")
    return dealt.mapInArrow(rows, f"{kinds}, obj_idx int, score double, rank int, gt_idx int, iou double")


def _numbers(table: pa.Table, by: list[str]) -> np.ndarray:
    """0, 1, ... for each run of equal keys."""
    change = np.zeros(table.num_rows, bool)
    for k in by:
        c = table.column(k).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def precision_by_scene(matches: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """by, ap: interpolated average precision of each small group that has labels."""
    w = Window.partitionBy(*by).orderBy("rank")
    tp = F.col("gt_idx").isNotNull().cast("int")
    ranked = matches.withColumn("precision", F.sum(tp).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("rank"))
    back = Window.partitionBy(*by).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    top = ranked.withColumn("best", F.max("precision").over(back))
    gained = top.groupBy(*by).agg(F.sum(F.when(tp == 1, F.col("best"))).alias("gained"))
    return labels.groupBy(*by).agg(F.count("*").alias("n")).join(gained, by, "left").select(*by, (F.coalesce("gained", F.lit(0.0)) / F.col("n")).alias("ap"))


def precision_by_class(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n_gt, n_detections, ap over the pooled detections of all scenes.

    Detections are ordered by score, then scene, then their order in it; a class of any size is spread over
    many tasks.
    """
    order = [F.col("score").desc(), F.col("sample_id"), F.col("rank")]
    slim = checkpointed(matches.select("label", "sample_id", "score", "rank", F.col("gt_idx").isNotNull().cast("int").alias("tp")))  # sorting reads it twice
    ran = running(in_order(slim, ["label"], order, keep=["label", "tp"]), ["label"], {"hits": F.col("tp"), "place": F.lit(1)})
    top = best_from_here(ran.withColumn("precision", F.col("hits") / F.col("place")), ["label"], "precision", "best")
    gained = top.groupBy("label").agg(F.sum(F.when(F.col("tp") == 1, F.col("best"))).alias("gained"), F.count("*").alias("n_detections"))
    truth = labels.groupBy("label").agg(F.count("*").alias("n_gt"))
    return truth.join(gained, "label", "left").select(
        "label", "n_gt", F.coalesce("n_detections", F.lit(0)).alias("n_detections"), (F.coalesce("gained", F.lit(0.0)) / F.col("n_gt")).alias("ap")
    )
