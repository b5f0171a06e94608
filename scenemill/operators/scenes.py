"""Spatial relations, walls, cameras, rays and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import grown
from ..functions.polygons import shared_outlines
from ..functions.rows import once
from .panoramas import edges
from .ranking import numbered

EXPAND, WALL, SHORT_EDGE, PAIRS = 0.1, 0.05, 1e-9, 1 << 20


def touching(objects: DataFrame, expand: float = EXPAND) -> DataFrame:
    """sample_id, source, target of objects that overlap once both are grown; heights first, then footprints. Upright boxes."""
    g = objects.select("sample_id", "obj_idx", grown(F.col("box"), expand).alias("g"))
    a, b = g.alias("a"), g.alias("b")
    meets = lambda k: F.least(F.col(f"a.g.{k}1"), F.col(f"b.g.{k}1")) > F.greatest(F.col(f"a.g.{k}0"), F.col(f"b.g.{k}0"))
    on = (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.obj_idx") < F.col("b.obj_idx")) & meets("z") & meets("x") & meets("y")
    return a.join(b, on).select(F.col("a.sample_id").alias("sample_id"), F.col("a.obj_idx").alias("source"), F.col("b.obj_idx").alias("target"))


_SIGNS = np.array([(i, j, k) for i in (-0.5, 0.5) for j in (-0.5, 0.5) for k in (-0.5, 0.5)])


def _flat(column: pa.Array, *shape: int) -> np.ndarray:
    """Nested lists of a fixed shape as numbers, rows that are null or of another shape as NaN."""
    some = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == shape[0])
    inner = column.take(pa.array(some)).flatten()
    out = np.full((len(column), *shape), np.nan)
    out[some] = (inner.to_numpy(zero_copy_only=False) if len(shape) == 1 else _flat(inner, *shape[1:])).reshape(len(some), *shape)
    return out


def _corners(center: np.ndarray, size: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """As `boxes.corners`, step by step, of many boxes."""
    total = np.zeros((len(center), 8, 3))
    for a in range(3):
        total = total + (_SIGNS[None, :, a] * size[:, None, a])[..., None] * basis[:, None, a]
    return center[:, None] + total


def shell_boxes(ring: np.ndarray, floor_z: float, ceiling_z: float, thickness: float = WALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, sizes and axes of a layout's floor, ceiling and a wall per edge of its ring, edges of no length left out."""
    low, high = ring.min(axis=0), ring.max(axis=0)
    along = np.roll(ring, -1, axis=0) - ring
    length = np.sqrt(along[:, 0] * along[:, 0] + along[:, 1] * along[:, 1])
    kept = length > SHORT_EDGE
    start, along, length = ring[kept], along[kept], length[kept]
    rise, n = ceiling_z - floor_z, len(length)
    middle = (low + high) / 2
    center = np.concatenate([[[*middle, floor_z], [*middle, ceiling_z]], np.column_stack([start + along / 2, np.full(n, floor_z + rise / 2)])])
    size = np.concatenate([[[*(high - low), thickness]] * 2, np.column_stack([length, np.full(n, thickness), np.full(n, rise)])])
    basis = np.tile(np.eye(3), (n + 2, 1, 1))
    if n:
        ax, ay = (along / length[:, None]).T
        basis[2:, 0, 0], basis[2:, 0, 1], basis[2:, 1, 0], basis[2:, 1, 1] = ax, ay, -ay, ax
    return center, size, basis


def _dealt_pairs(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows, each as often as its count, and 0, 1, ... within each; PAIRS at a time, or one row's."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        own = counts[at:stop]
        i = np.repeat(np.arange(at, stop), own)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        at = stop


class _Placed:
    """Grown boxes of many scenes: corners, bounds, whether along the axes."""

    def __init__(self, center: np.ndarray, size: np.ndarray, basis: np.ndarray, expand: float):
        self.corners = _corners(center, np.maximum(size + expand, 0.01), basis)
        self.low, self.high = self.corners.min(axis=1), self.corners.max(axis=1)
        self.square = basis[:, 0, 0] * basis[:, 0, 1] == 0


def _meet(a: _Placed, b: _Placed, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs overlap: heights and bounds first; only those not along the axes go on to have their footprints clipped."""
    for d in (2, 0, 1):
        near = np.minimum(a.high[i, d], b.high[j, d]) > np.maximum(a.low[i, d], b.low[j, d])
        if d == 2:
            at = np.flatnonzero(near)
        else:
            at = at[near]
        i, j = i[near], j[near]
    fit = a.square[i] & b.square[j]
    slanted = np.flatnonzero(~fit)
    fit[slanted] = shared_outlines(a.corners[i[slanted]], b.corners[j[slanted]]) > 0
    return at[fit]


def relations(objects: DataFrame, layouts: DataFrame, expand: float = EXPAND) -> DataFrame:
    """sample_id, source, target, relation_type: objects that touch each other, the floor, the ceiling or a wall once all are grown.

    objects: sample_id, obj_idx, object_id, box (oriented); an object comes before those of higher obj_idx. layouts: sample_id, ring,
    floor_z, ceiling_z. A scene is a row with its objects and layouts; pairs are compared as arrays, PAIRS at a time, for many small
    scenes or a part of a crowded one, and only those that touch become rows.
    """
    o = objects.where("sample_id is not null").groupBy("sample_id").agg(F.collect_list(F.struct("obj_idx", F.col("object_id").cast("string").alias("object_id"), "box")).alias("_o"))
    h = layouts.groupBy("sample_id").agg(F.collect_list(F.struct("ring", F.col("floor_z").cast("double").alias("floor_z"), F.col("ceiling_z").cast("double").alias("ceiling_z"))).alias("_h"))
    kind = objects.schema["sample_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, held, shells = batch.column(0), batch.column(1), batch.column(2)
            scene = np.repeat(np.arange(len(batch)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
            own = held.flatten()
            number, source, boxes = (own.field(c) for c in ("obj_idx", "object_id", "box"))
            number = number.to_numpy(zero_copy_only=False)
            there = boxes.is_valid().to_numpy(zero_copy_only=False)
            a = _Placed(*(_flat(pc.struct_field(boxes, c), *shape) for c, shape in (("center", (3,)), ("size", (3,)), ("basis", (3, 3)))), expand)
            a.low[~there] = np.nan
            first = np.searchsorted(scene, np.arange(len(batch)), side="left")
            count = np.searchsorted(scene, np.arange(len(batch)), side="right") - first

            def told(i: np.ndarray, target: pa.Array, relation: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([names.take(pa.array(scene[i])), source.take(pa.array(i)), target, relation], names=["sample_id", "source", "target", "relation_type"])

            for i, k in _dealt_pairs(count[scene]):
                j = first[scene[i]] + k
                ahead = number[i] < number[j]
                i, j = i[ahead], j[ahead]
                fit = _meet(a, a, i, j)
                if len(fit):
                    yield told(i[fit], source.take(pa.array(j[fit])), pa.array(["touching"]).take(pa.array(np.zeros(len(fit), int))))
            parts, titles, of = [], [], []
            for k, each in enumerate(shells.to_pylist()):
                for s in each or ():
                    ring = np.array([[p[0], p[1]] for p in s["ring"]], float).reshape(-1, 2) if s["ring"] else np.zeros((0, 2))
                    if len(ring) and s["floor_z"] is not None and s["ceiling_z"] is not None:
                        parts.append(shell_boxes(ring, s["floor_z"], s["ceiling_z"]))
                        titles += [-2, -1, *range(len(parts[-1][0]) - 2)]
                        of += [k] * len(parts[-1][0])
            if not parts:
                continue
            b, of, titles = _Placed(*(np.concatenate(x) for x in zip(*parts)), expand), np.array(of), np.array(titles)
            title = pa.array(["layout::floor", "layout::ceiling", *(f"layout::wall_{k}" for k in range(titles.max() + 1))])
            relation = pa.array(["touching_floor", "touching_ceiling", "touching_wall"])
            begin = np.searchsorted(of, np.arange(len(batch)), side="left")
            sides = np.searchsorted(of, np.arange(len(batch)), side="right") - begin
            for i, k in _dealt_pairs(sides[scene]):
                j = begin[scene[i]] + k
                fit = _meet(a, b, i, j)
                if len(fit):
                    t = titles[j[fit]] + 2
                    yield told(i[fit], title.take(pa.array(t)), relation.take(pa.array(np.minimum(t, 2))))

    return o.join(h, "sample_id", "left").select("sample_id", "_o", "_h").mapInArrow(rows, f"sample_id {kind}, source string, target string, relation_type string")


def walls(rooms: DataFrame, ring: str = "ring", thickness: float = WALL) -> DataFrame:
    """A box per edge of a room's contour: room columns, edge, cx, cy, cz, length, thickness, height, ax, ay (direction).

    ring: array of [x, y], not closed; rooms also have floor_z and ceiling_z. Edges of no length are left out.
    """
    keep = [c for c in rooms.columns if c not in (ring, "floor_z", "ceiling_z")]
    e = rooms.select(*keep, "floor_z", "ceiling_z", F.col(ring).alias("_r"), F.posexplode(ring).alias("edge", "p"))
    e = e.withColumn("q", F.element_at("_r", ((F.col("edge") + 1) % F.size("_r") + 1).cast("int")))
    dx, dy = F.col("q")[0] - F.col("p")[0], F.col("q")[1] - F.col("p")[1]
    e = e.withColumn("length", F.sqrt(dx * dx + dy * dy)).where(F.col("length") > SHORT_EDGE)
    return e.select(
        *keep, "edge", ((F.col("p")[0] + F.col("q")[0]) / 2).alias("cx"), ((F.col("p")[1] + F.col("q")[1]) / 2).alias("cy"), ((F.col("floor_z") + F.col("ceiling_z")) / 2).alias("cz"),
        "length", F.lit(thickness).alias("thickness"), (F.col("ceiling_z") - F.col("floor_z")).alias("height"), (dx / F.col("length")).alias("ax"), (dy / F.col("length")).alias("ay"),
    )


def camera_grid(rooms: DataFrame, steps: int = 31, margin: float = 0.0) -> DataFrame:
    """room columns, ix, iy, px, py: an even grid over each room's bounds x0, y0, x1, y1, less a margin."""
    i, j = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("ix"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("iy")
    g = rooms.select("*", i).select("*", j)
    at = lambda k, n: F.col(f"{k}0") + margin + (F.col(f"{k}1") - F.col(f"{k}0") - 2 * margin) * F.col(n) / (steps - 1)
    return g.withColumns({"px": at("x", "ix"), "py": at("y", "iy")})


def ray_ranges(rooms: DataFrame, key: str, columns: int, ring: str = "ring") -> DataFrame:
    """key, col, distance from (cx, cy) to the contour along each of `columns` directions; null where a ray meets none.

    All of it is worked out in the room's row; nothing is shuffled.
    """
    sides = once(rooms.select(key, "cx", "cy", F.col(ring).alias("_r")), _e=edges(F.col("_r")))

    def nearest(col: Column) -> Column:
        turn = (col + 0.5) * (2 * 3.141592653589793 / columns)
        ux, uy = F.cos(turn), F.sin(turn)

        def hit(e: Column) -> Column:
            cross, px, py = ux * e["ey"] - uy * e["ex"], e["x"] - F.col("cx"), e["y"] - F.col("cy")
            along, share = (px * e["ey"] - py * e["ex"]) / cross, (px * uy - py * ux) / cross
            return F.when((F.abs(cross) > 1e-12) & (along >= 0) & (share >= 0) & (share <= 1), along)

        return F.array_min(F.transform("_e", hit))

    return sides.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), nearest)).alias("col", "distance"))


def mask_runs(pixels: DataFrame, key: str) -> DataFrame:
    """key, counts from key, pos, on: lengths of runs over positions in order, the first being of pixels that are off (0 if none is)."""
    w = Window.partitionBy(key).orderBy("pos")
    changed = pixels.withColumn("_c", (F.col("on") != F.lag("on", 1, 0).over(w)).cast("int"))
    runs = changed.withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = runs.groupBy(key, "_run").agg(F.count("*").alias("n"))
    ordered = lengths.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_run", "n"))).alias("r"))
    return ordered.select(key, F.when(F.col("r")[0]["_run"] == 1, F.concat(F.array(F.lit(0).cast("long")), F.col("r.n"))).otherwise(F.col("r.n")).alias("counts"))


def annotation_faults(width: Column, height: Column, bbox: Column, area: Column, counts: Column) -> Column:
    """What is wrong with an annotation: a box outside the image, runs that are negative or do not fill it, an area that is not the mask's or is more than its box."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    inside = F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)
    out = (bbox[0] < 0) | (bbox[1] < 0) | (bbox[2] <= 0) | (bbox[3] <= 0) | (bbox[0] + bbox[2] > width) | (bbox[1] + bbox[3] > height)
    runs = (F.size(counts) == 0) | F.exists(counts, lambda x: x < 0) | (total != width * height)
    sized = (inside == area) & (area > 0) & (area <= bbox[2] * bbox[3])
    wrong = lambda c: F.coalesce(c, F.lit(True))  # noqa: E731  a number that is missing is a fault
    return F.array_compact(F.array(F.when(wrong(out), "box"), F.when(wrong(runs), "runs"), F.when(wrong(~sized), "area")))


def renumber(images: DataFrame, annotations: DataFrame, order: list[Column], annotation_order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of merged parts with ids 1, 2, ...; annotations follow their image. Old keys: part, image_id, ann_id."""
    new_images = numbered(images, order, "new_image_id")
    joined = annotations.join(new_images.select("part", "image_id", "new_image_id"), ["part", "image_id"])
    return new_images, numbered(joined, annotation_order, "new_ann_id")


def padded_box(bbox: Column, width: Column, height: Column, margin: float) -> Column:
    """[left, top, right, bottom] of a crop: the box widened by a share of its size, rounded half to even, kept in the image."""
    dx, dy = bbox[2] * margin, bbox[3] * margin
    low = lambda v: F.greatest(F.bround(v).cast("int"), F.lit(0))
    return F.array(low(bbox[0] - dx), low(bbox[1] - dy), F.least(F.bround(bbox[0] + bbox[2] + dx).cast("int"), width), F.least(F.bround(bbox[1] + bbox[3] + dy).cast("int"), height))


def chosen_cameras(candidates: Column, views: int) -> Column:
    """Of an array of (x, y, clearance): the one of best clearance, then again and again the farthest from all chosen, ties by clearance, then point."""
    ordered = F.array_sort(candidates, lambda a, b: F.when(a["clearance"] > b["clearance"], -1).when(a["clearance"] < b["clearance"], 1).when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(0))

    def step(held: Column, _: Column) -> Column:
        def rank(c: Column, i: Column) -> Column:
            far = F.array_min(F.transform(held, lambda h: (h["x"] - c["x"]) * (h["x"] - c["x"]) + (h["y"] - c["y"]) * (h["y"] - c["y"])))
            return F.struct(far.alias("far"), c["clearance"].alias("clearance"), (-i).alias("i"), c.alias("c"))

        best = F.array_max(F.transform(F.transform(ordered, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda s: rank(s["c"], s["i"])))
        return F.concat(held, F.filter(F.array(best["c"]), lambda c: F.size(held) < F.size(ordered)))

    return F.aggregate(F.sequence(F.lit(2), F.lit(views)), F.slice(ordered, 1, 1), step)
