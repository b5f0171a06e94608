"""Point clouds: normalising, exact nearest neighbours, Chamfer distance and F-score, in native expressions.

A cloud is an array of points, a point an array of three. For clouds of tens of points this needs no Python;
`cloud_scores` does the same with numpy, in blocks, for clouds of thousands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def _axis(cloud: Column, d: int) -> Column:
    return F.transform(cloud, lambda p: p[d])


def centroid(cloud: Column) -> Column:
    return F.array(*[F.aggregate(_axis(cloud, d), F.lit(0.0), lambda s, x: s + x) / F.size(cloud) for d in range(3)])


def box_centre(cloud: Column) -> Column:
    return F.array(*[(F.array_min(_axis(cloud, d)) + F.array_max(_axis(cloud, d))) / 2 for d in range(3)])


def diagonal(cloud: Column) -> Column:
    """Length of the bounding box's diagonal; 1 where it is nothing."""
    sides = [F.array_max(_axis(cloud, d)) - F.array_min(_axis(cloud, d)) for d in range(3)]
    total = F.sqrt(sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2])
    return F.when(total > 0, total).otherwise(1.0)


def moved(cloud: Column, origin: Column, scale: Column) -> Column:
    """(p - origin) / scale of each point; origin and scale are columns of the frame, so each is worked out once."""
    return F.transform(cloud, lambda p: F.array(*[(p[d] - origin[d]) / scale for d in range(3)]))


def normalized(df: DataFrame, pred: str, truth: str, how: str) -> DataFrame:
    """`unit`: both clouds by the truth's centroid and diagonal. `canonical`: each by its own box. `none`: as they are."""
    if how == "none":
        return df
    if how not in ("unit", "canonical"):
        raise ValueError(f"unknown normalisation {how!r}")
    for name in (pred, truth):
        source = truth if how == "unit" else name
        origin = centroid(F.col(source)) if how == "unit" else box_centre(F.col(source))
        df = df.withColumns({f"_o_{name}": origin, f"_s_{name}": diagonal(F.col(source))})
    return df.withColumns({n: moved(F.col(n), F.col(f"_o_{n}"), F.col(f"_s_{n}")) for n in (pred, truth)}).drop(*[f"_{k}_{n}" for k in "os" for n in (pred, truth)])


def nearest(a: Column, b: Column) -> Column:
    """Of each point of a, the squared distance to the closest of b."""
    between = lambda p: lambda q: (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])
    return F.transform(a, lambda p: F.array_min(F.transform(b, between(p))))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def chamfer(forth: Column, back: Column, squared: bool = True) -> Column:
    """Sum of the two mean distances, from nearest() both ways."""
    if not squared:
        forth, back = F.transform(forth, F.sqrt), F.transform(back, F.sqrt)
    return _mean(forth) + _mean(back)


def fscore(forth: Column, back: Column, threshold: float = 0.1) -> Column:
    """Harmonic mean of the shares of points within the threshold; 0 if both shares are."""
    share = lambda x: F.size(F.filter(x, lambda v: v <= threshold * threshold)) / F.size(x)
    p, r = share(forth), share(back)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances to the closest of b, in blocks of a."""
    return np.concatenate([((a[i : i + BLOCK, None, :] - b[None]) ** 2).sum(axis=2).min(axis=1) for i in range(0, len(a), BLOCK)])


def numpy_normalized(a: np.ndarray, b: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """As normalized, of a prediction and its truth."""
    size = lambda x: float(np.sqrt(((x.max(axis=0) - x.min(axis=0)) ** 2).sum())) or 1.0
    if how == "unit":
        return (a - b.mean(axis=0)) / size(b), (b - b.mean(axis=0)) / size(b)
    if how == "canonical":
        return tuple((x - (x.min(axis=0) + x.max(axis=0)) / 2) / size(x) for x in (a, b))
    return a, b


def cloud_scores(pairs: DataFrame, key: str, pred: str = "pred", truth: str = "truth", threshold: float = 0.1, how: str = "none", squared: bool = True) -> DataFrame:
    """key, chamfer, fscore of pairs of large clouds."""
    if how not in ("none", "unit", "canonical"):
        raise ValueError(f"unknown normalisation {how!r}")
    kind = pairs.schema[key].dataType.simpleString()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k, a, b in zip(pdf[key], pdf[pred], pdf[truth]):
                a, b = numpy_normalized(*(np.array([list(p) for p in x], float) for x in (a, b)), how)
                forth, back = distances(a, b), distances(b, a)
                p, r = (forth <= threshold**2).mean(), (back <= threshold**2).mean()
                if not squared:
                    forth, back = np.sqrt(forth), np.sqrt(back)
                out.append((k, forth.mean() + back.mean(), 2 * p * r / (p + r) if p + r else 0.0))
            yield pd.DataFrame(out, columns=[key, "chamfer", "fscore"])

    return pairs.select(key, pred, truth).mapInPandas(rows, f"{key} {kind}, chamfer double, fscore double")
