"""Panoramas: where a room's corners and edges fall, and instances that cross the seam.

A panorama of `width` columns looks all round; column i looks along longitude (i + 0.5) / width of a turn, from
minus half a turn, with y ahead and x to the right. Contours stay in their room's row: a column's distance is
the least over the edges, worked out as arrays inside an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import regions as R

NEAR, VALUES = 1e-7, 1 << 20
FADE = 0.96


def corner_pixels(ring: Column, camera: Column, floor_z: Column, ceiling_z: Column, width: int, height: int) -> Column:
    """Structs x, ceiling_y, floor_y of a contour's corners in its own order, from the leftmost one on (the first, if there are more)."""

    def seen(p: Column, i: Column) -> Column:
        dx, dy = p[0] - camera[0], p[1] - camera[1]
        radius = F.sqrt(dx * dx + dy * dy)
        x = F.pmod(F.atan2(dx, dy) / (2 * pi) + 0.5, F.lit(1.0)) * width - 0.5
        at = lambda z: (0.5 - F.atan2(z - camera[2], radius) / pi) * height - 0.5
        return F.struct(x.alias("x"), i.alias("i"), at(ceiling_z).alias("ceiling_y"), at(floor_z).alias("floor_y"))

    corners = F.transform(ring, seen)
    first = F.array_min(F.transform(corners, lambda c: F.struct(c["x"].alias("x"), c["i"].alias("i"))))["i"]
    rolled = F.concat(F.slice(corners, first + 1, F.size(corners)), F.slice(corners, 1, first))
    return F.transform(rolled, lambda c: F.struct(c["x"].alias("x"), c["ceiling_y"].alias("ceiling_y"), c["floor_y"].alias("floor_y")))


def camera_faults(rings: Column, camera: Column, floor_z: Column, ceiling_z: Column) -> Column:
    """Why a camera cannot see a room's contour (an outer ring and its holes): it is not inside, an edge being outside, or not between floor and ceiling."""
    inside = R.covers(rings, camera[0], camera[1]) & (R.edge_distance(rings, camera[0], camera[1]) > 1e-12)
    between = (camera[2] > floor_z) & (camera[2] < ceiling_z)
    return F.array_compact(F.array(F.when(~F.coalesce(inside, F.lit(False)), "outside"), F.when(~F.coalesce(between, F.lit(False)), "height")))


def paired_by_column(corners: Column) -> Column:
    """Corners as ceiling, floor, ceiling, floor, ...: each pair shares the ceiling's column, pairs go by column, then in order."""
    n = F.size(corners) / 2
    pair = lambda k: F.struct(F.get(corners, k * 2)["x"].alias("x"), k.alias("k"), F.get(corners, k * 2)["y"].alias("top"), F.get(corners, k * 2 + 1)["y"].alias("bottom"))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), pair))
    both = lambda c: F.array(F.struct(c["x"].alias("x"), c["top"].alias("y")), F.struct(c["x"].alias("x"), c["bottom"].alias("y")))
    return F.flatten(F.transform(pairs, both))


def edges(ring: Column) -> Column:
    """Structs x, y, ex, ey: where each edge of an open ring starts and how far it goes."""
    end = lambda i, d: F.get(ring, (i + 1) % F.size(ring))[d]
    return F.transform(ring, lambda p, i: F.struct(p[0].alias("x"), p[1].alias("y"), (end(i, 0) - p[0]).alias("ex"), (end(i, 1) - p[1]).alias("ey")))


def _nearest(ex: np.ndarray, ey: np.ndarray, dx: np.ndarray, dy: np.ndarray, ux: np.ndarray, uy: np.ndarray) -> np.ndarray:
    """How far a ray along (ux, uy) goes to an edge that starts at (dx, dy) from it; infinite where it is not met."""
    cross = ux * ey - uy * ex
    along, share = (dx * ey - dy * ex) / cross, (dx * uy - dy * ux) / cross
    return np.where((np.abs(cross) > 1e-10) & (along > NEAR) & (share >= -NEAR) & (share <= 1 + NEAR), along, np.inf)


def _least(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The least of each run of so many rows; infinite for an empty one."""
    out = np.full((len(counts), *values.shape[1:]), np.inf)
    some = counts > 0
    if some.any():
        out[some] = np.minimum.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def target_arrays(xy: np.ndarray, counts: np.ndarray, camera: np.ndarray, floor_z: np.ndarray, ceiling_z: np.ndarray, width: int) -> list[np.ndarray]:
    """ranges, ceiling, floor, corner (rooms, width) of rooms whose contours stand one after another in xy; not a number where there is none.

    Every edge meets every column, and every corner of a room every edge of it, VALUES at a time.
    """
    ranges, fade = np.full((len(counts), width), np.inf), np.full((len(counts), width), np.inf)
    starts = np.cumsum(counts) - counts
    with np.errstate(all="ignore"):
        turn = ((np.arange(width) + 0.5) / width - 0.5) * (2 * pi)
        ux, uy = np.sin(turn), np.cos(turn)
        room = np.repeat(np.arange(len(counts)), counts)
        last = starts[room] + counts[room] - 1
        after = np.where(np.arange(len(xy)) == last, starts[room], np.arange(len(xy)) + 1)
        (ex, ey), (dx, dy) = (xy[after] - xy).T, (xy - camera[room, :2]).T
        far = np.sqrt(dx * dx + dy * dy)
        met = np.full(len(xy), np.inf)
        for k, n in _blocks(counts[room]):
            own = counts[room[k:n]]
            i = np.repeat(np.arange(k, n), own)
            j = starts[room[i]] + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            met[k:n] = _least(_nearest(ex[j], ey[j], dx[j], dy[j], dx[i] / far[i], dy[i] / far[i]), own)
        seen = np.abs(met - far) <= np.maximum(far * 1e-5, 1e-6)
        at = np.where(seen, np.mod(np.arctan2(dx, dy) / (2 * pi) + 0.5, 1.0) * width - 0.5, np.nan)
        for k, n in _blocks(counts * width):
            p = slice(starts[k], starts[n - 1] + counts[n - 1])
            ranges[k:n] = _least(_nearest(ex[p, None], ey[p, None], dx[p, None], dy[p, None], ux, uy), counts[k:n])
            apart = np.abs(np.arange(width) - at[p, None])
            fade[k:n] = _least(np.where(seen[p, None], np.minimum(apart, width - apart), np.inf), counts[k:n])
        ranges[np.isinf(ranges)] = np.nan
        corner = np.where(np.isinf(fade), np.nan, FADE**fade)
        return [ranges, -np.arctan2((ceiling_z - camera[:, 2])[:, None], ranges), np.arctan2((camera[:, 2] - floor_z)[:, None], ranges), corner]


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes come to VALUES at most, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VALUES, side="right")))
        yield at, stop
        at = stop


def _firsts(column: pa.Array, n: int) -> np.ndarray:
    """The first n numbers of each list; not a number where a list is shorter or null."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out, starts = np.full((len(column), n), np.nan), np.cumsum(sizes) - sizes
    for d in range(n):
        some = sizes > d
        out[some, d] = values[starts[some] + d]
    return out


def layout_targets(rooms: DataFrame, width: int) -> DataFrame:
    """rooms (ring, camera, floor_z, ceiling_z) with ranges, ceiling and floor (latitudes, down being positive) of each column, and corner.

    corner: FADE to the power of a column's distance, all round, from the nearest corner that the camera sees. Few bytes are much
    arithmetic, so rooms are dealt over all shuffle partitions; contours are worked on as arrays, many rooms at a time.
    """
    names = ("ranges", "ceiling", "floor", "corner")

    @F.arrow_udf(StructType([StructField(n, ArrayType(DoubleType())) for n in names]))
    def targets(ring: pa.Array, camera: pa.Array, floor_z: pa.Array, ceiling_z: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False).astype(int)
        levels = [c.to_numpy(zero_copy_only=False).astype(float) for c in (floor_z, ceiling_z)]
        found = target_arrays(_firsts(ring.flatten(), 2), counts, _firsts(camera, 3), *levels, width)
        offsets = pa.array(np.arange(len(ring) + 1) * width, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), from_pandas=True)) for x in found], names=list(names))

    spread = rooms.repartition(int(rooms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = targets(F.col("ring"), F.col("camera"), F.col("floor_z").cast("double"), F.col("ceiling_z").cast("double"))
    return spread.withColumn("_t", made).select(*rooms.columns, *[F.col("_t")[n].alias(n) for n in names])


def target_faults(ceiling: Column, floor: Column, corner: Column, ranges: Column, width: int) -> Column:
    """What is wrong with a room's targets, as an array: lengths, signs, numbers out of range."""
    whole = lambda a: F.size(a) == width
    wrong = lambda a, test: F.exists(a, lambda v: v.isNull() | F.isnan(v) | ~test(v))
    return F.array_compact(F.array(
        F.when(~(whole(ceiling) & whole(floor) & whole(corner)), "length"),
        F.when(wrong(ceiling, lambda v: (v < 0) & (v > -pi / 2)), "ceiling"), F.when(wrong(floor, lambda v: (v > 0) & (v < pi / 2)), "floor"),
        F.when(wrong(corner, lambda v: (v >= 0) & (v <= 1)), "corner"), F.when(wrong(ranges, lambda v: (v > 0) & (v < float("inf"))), "ranges"),
    ))


def widest_gap(columns: Column, width: int) -> Column:
    """Struct start, length of the longest run of columns that a mask leaves empty, the first among equals; null if none is. columns: sorted, distinct."""
    fence = F.concat(F.array(F.lit(-1)), columns.cast("array<int>"), F.array(F.lit(width)))
    gaps = F.transform(F.slice(fence, 2, F.size(fence) - 1), lambda c, i: F.struct((c - F.get(fence, i) - 1).alias("length"), (-F.get(fence, i) - 1).alias("less")))
    best = F.filter(F.array(F.array_max(gaps)), lambda g: g["length"] > 0)
    return F.get(F.transform(best, lambda g: F.struct((-g["less"]).alias("start"), g["length"].alias("length"))), F.lit(0))


def seam_plan(masks: DataFrame, width: int) -> DataFrame:
    """masks (columns: the occupied ones, sorted and distinct) with frame and cut.

    A mask that touches both edges moves to frame 1, turned by half the width; if it touches both edges there too it stays in
    frame 0 and is cut in the middle of its widest gap (cut: the first column of the right part).
    """
    held = lambda c: F.array_contains("columns", F.lit(c).cast("long"))
    half = width // 2
    at_seam, turned = held(0) & held(width - 1), held((width - half) % width) & held((width - 1 - half) % width)
    gap = widest_gap(F.col("columns"), width)
    return masks.withColumns({
        "frame": F.when(at_seam & ~turned, 1).otherwise(0),
        "cut": F.when(at_seam & turned, gap["start"] + F.floor(gap["length"] / 2)).cast("long"),
    })


def seam_pieces(pixels: DataFrame, key: str, width: int) -> DataFrame:
    """key, frame, piece, x, y, w, h, area: tight boxes of the pieces of each mask (rows key, row, col). At most `width` columns a mask are held."""
    plan = seam_plan(pixels.groupBy(key).agg(F.sort_array(F.collect_set(F.col("col").cast("long"))).alias("columns")), width)
    placed = pixels.join(plan.select(key, "frame", "cut"), key)
    col = F.when(F.col("frame") == 1, F.pmod(F.col("col") + width // 2, F.lit(width))).otherwise(F.col("col"))
    piece = F.when(F.col("col") >= F.col("cut"), 1).otherwise(0)
    boxes = placed.withColumns({"_c": col, "piece": piece}).groupBy(key, "frame", "piece").agg(
        F.min("_c").alias("x"), F.min("row").alias("y"), (F.max("_c") - F.min("_c") + 1).alias("w"), (F.max("row") - F.min("row") + 1).alias("h"), F.count("*").alias("area")
    )
    return boxes


# fixed values: what makes a picture suspicious, as (statistic, whether above, bound, flag)
IMAGE_LIMITS = [
    ("dark_fraction", True, 0.80, "mostly_dark"), ("bright_fraction", True, 0.80, "mostly_clipped"), ("rgb_std", False, 0.02, "almost_uniform_rgb"),
    ("depth_valid_fraction", False, 0.95, "missing_depth"), ("near_surface_fraction", True, 0.20, "near_surface_dominates"),
]


def image_statistics(pixels: DataFrame, key: str, room_height: Column) -> DataFrame:
    """key, mean, spread, dark, bright, valid and near shares, and flags of pictures as rows of pixels (key, r, g, b: 0 to 255, depth)."""
    gray, depth = (F.col("r") + F.col("g") + F.col("b")) / 3 / 255, F.col("depth")
    valid = F.coalesce(~F.isnan(depth) & (depth > 0) & (depth < 1e6), F.lit(False))
    share = lambda c: F.avg(c.cast("int"))
    stats = pixels.groupBy(key).agg(
        F.avg(gray).alias("rgb_mean"), F.stddev_pop(gray).alias("rgb_std"), share(gray < 0.025).alias("dark_fraction"), share(gray > 0.98).alias("bright_fraction"),
        share(valid).alias("depth_valid_fraction"), share(valid & (depth < 0.05 * room_height)).alias("near_surface_fraction"),
    )
    flags = [F.when(F.col(n) > bound if above else F.col(n) < bound, F.lit(flag)) for n, above, bound, flag in IMAGE_LIMITS]
    return stats.withColumn("flags", F.array_compact(F.array(*flags)))
