"""Axis-aligned boxes as structs x0, y0, z0, x1, y1, z1, in native expressions.

NaN never wins a comparison here: a minimum or maximum keeps its first argument unless the second is
strictly better, and a length that is NaN or negative counts 0. Spark's own functions order NaN last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"


def first_min(a: Column, b: Column) -> Column:
    return -first_max(-a, -b)


def first_max(a: Column, b: Column) -> Column:
    return F.greatest(a, F.nanvl(b, a))


def length(x: Column) -> Column:
    """x where it is a number above 0, else 0; null stays null. Each use of x is written out anew in the plan, so there are few."""
    return F.nanvl(x * 0.5 + F.abs(x) * 0.5, F.lit(0.0))


def box(x0, y0, z0, x1, y1, z1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "z0", "x1", "y1", "z1"), (x0, y0, z0, x1, y1, z1))])


def valid(b: Column) -> Column:
    """Whether no corner lies beyond the other; NaN passes."""
    bad = [~F.isnan(b[f"{a}0"]) & ~F.isnan(b[f"{a}1"]) & (b[f"{a}0"] > b[f"{a}1"]) for a in AXES]
    return ~(bad[0] | bad[1] | bad[2])


def volume(b: Column) -> Column:
    return length(b["x1"] - b["x0"]) * length(b["y1"] - b["y0"]) * length(b["z1"] - b["z0"])


def overlap(a: Column, b: Column) -> Column:
    """Volume of the intersection; null where either is."""
    sides = [length(first_min(a[f"{k}1"], b[f"{k}1"]) - first_max(a[f"{k}0"], b[f"{k}0"])) for k in AXES]
    return F.when(a.isNotNull() & b.isNotNull(), sides[0] * sides[1] * sides[2])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union is nothing."""
    shared = overlap(a, b)
    return F.coalesce(F.try_divide(shared, volume(a) + volume(b) - shared), F.lit(0.0))


def as_oriented(b: Column) -> Column:
    """Centre, size and axes of an axis-aligned box."""
    pairs = [(b[f"{a}0"], b[f"{a}1"]) for a in AXES]
    return F.struct(
        F.array(*[(p + q) / 2 for p, q in pairs]).alias("center"),
        F.array(*[q - p for p, q in pairs]).alias("size"),
        F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)]).alias("basis"),
    )


def sanitized(b: Column) -> Column:
    """An oriented box whose numbers that are not finite are 0 and whose negative sizes are 0."""
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.struct(
        F.transform(b["center"], finite).alias("center"),
        F.transform(b["size"], lambda x: F.greatest(finite(x), F.lit(0.0))).alias("size"),
        F.transform(b["basis"], lambda row: F.transform(row, finite)).alias("basis"),
    )


def corners(b: Column) -> Column:
    """The eight corners of an oriented box, as arrays of three; rows of the basis are its axes."""
    signs = F.array(*[F.array(*[F.lit(s) for s in (i, j, k)]) for i in (-0.5, 0.5) for j in (-0.5, 0.5) for k in (-0.5, 0.5)])

    def corner(s: Column) -> Column:
        return F.array(*[b["center"][d] + sum((s[a] * b["size"][a] * b["basis"][a][d] for a in range(3)), F.lit(0.0)) for d in range(3)])

    return F.transform(signs, corner)


def part(d: int):
    return lambda p: p[d]


def bounds(points: Column) -> Column:
    """The axis-aligned box around points."""
    along = [F.transform(points, part(d)) for d in range(3)]
    return box(*map(F.array_min, along), *map(F.array_max, along))


def grown(b: Column, distance: float, least: float = 0.01) -> Column:
    """The box with `distance` added to each edge, half on each side, edges being `least` at least."""
    centre = [(b[f"{a}0"] + b[f"{a}1"]) / 2 for a in AXES]
    half = [F.greatest(b[f"{a}1"] - b[f"{a}0"] + distance, F.lit(least)) / 2 for a in AXES]
    return box(*[c - h for c, h in zip(centre, half)], *[c + h for c, h in zip(centre, half)])
