"""Where cameras stand in a room: candidates, furniture below them, and the choice of views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planes import distinct_candidates

STANDABLE = 0.1
# fixed values: clearance asked for, at most and as a share of the room's height
CLEARANCE, CLEARANCE_SHARE = 0.1, 0.04


def least_clearance(height: Column) -> Column:
    return F.least(F.lit(CLEARANCE), height * CLEARANCE_SHARE)


def eye_height(floor_z: Column, height: Column, camera_height: float, share: float) -> Column:
    """How high a camera stands: camera_height above the floor, or a share of the room's height where that is less."""
    if not 0.2 <= share <= 0.8:
        raise ValueError("the share of the height must be from 0.2 to 0.8")
    if not 0 < camera_height < float("inf"):
        raise ValueError("the camera's height must be a positive number")
    return floor_z + F.least(F.lit(camera_height), height * share)


def over_furniture(candidates: DataFrame, boxes: DataFrame, rooms: DataFrame, key: str, standable: float = STANDABLE) -> DataFrame:
    """candidates with `on_furniture`: whether one is above a box (key, box) that is higher than a share of its room (key, floor_z, height).

    A room's boxes are one array, so candidates are not multiplied by them.
    """
    b = F.col("box")
    high = boxes.join(rooms.select(key, (F.col("floor_z") + F.col("height") * standable).alias("_top")), key).where(b["z1"] > F.col("_top"))
    held = high.groupBy(key).agg(F.collect_list(F.struct(*[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("_boxes"))
    above = F.exists("_boxes", lambda o: F.col("x").between(o["x0"], o["x1"]) & F.col("y").between(o["y0"], o["y1"]))
    return candidates.join(held, key, "left").withColumn("on_furniture", F.coalesce(above, F.lit(False))).drop("_boxes")


def chosen_views(candidates: DataFrame, rooms: DataFrame, key: str, views: int, relaxed: bool = False) -> DataFrame:
    """key, fault, fell_back, below_clearance, cameras (x, y, z, clearance) of each room (key, min_clearance).

    candidates: key, x, y, z, clearance, on_furniture. Those on furniture count where the others are fewer than the views. Of what is
    left, points alike in seven decimals once, those of enough clearance are the pool, by falling clearance, then by point; if they are
    too few and `relaxed` says so, the best of the rest fill it up to the views. The first of the pool is taken, then again
    and again the one farthest from above from all taken ones, ties by clearance, then by place in the pool. Distances are roots of sums
    of squares, each step rounded as SQL rounds it: another way to the same length parts or joins ties.
    """
    if views < 1:
        raise ValueError("at least one view is needed")
    free = candidates.groupBy(key).agg(F.count_if(~F.col("on_furniture")).alias("_free"))
    used = candidates.join(free, key).where(~F.col("on_furniture") | (F.col("_free") < views))
    fell = used.groupBy(key).agg(F.max("on_furniture").alias("fell_back"))
    spots = distinct_candidates(used.select(key, "x", "y", "z", "clearance"), key)
    by_rank = F.sort_array(F.collect_list(F.struct((-F.col("clearance")).alias("less"), "x", "y", "z", "clearance")))
    held = spots.groupBy(key).agg(by_rank.alias("_all"))
    joined = rooms.select(key, "min_clearance").join(held, key, "left").join(fell, key, "left")
    everything = F.coalesce("_all", F.array().cast(held.schema["_all"].dataType))
    enough = F.filter(everything, lambda c: c["clearance"] >= F.col("min_clearance"))
    rest = F.filter(everything, lambda c: c["clearance"] < F.col("min_clearance"))
    filled = F.concat(enough, F.slice(rest, 1, F.greatest(views - F.size(enough), F.lit(0)))) if relaxed else enough
    pooled = joined.select(key, F.coalesce("fell_back", F.lit(False)).alias("fell_back"), F.size(enough).alias("_enough"), filled.alias("_pool"))

    distance = lambda dx, dy: F.sqrt(dx * dx + dy * dy)

    def step(taken: Column, _: Column) -> Column:
        """taken: places in the pool."""
        def rank(c: Column, i: Column) -> Column:
            away = F.array_min(F.transform(taken, lambda k: distance(F.get(F.col("_pool"), k)["x"] - c["x"], F.get(F.col("_pool"), k)["y"] - c["y"])))
            return F.when(~F.array_contains(taken, i), F.struct(away.alias("away"), c["clearance"].alias("clearance"), (-i).alias("back")))

        return F.concat(taken, F.array(-F.array_max(F.transform("_pool", rank))["back"]))

    order = F.aggregate(F.sequence(F.lit(1), F.lit(views - 1)) if views > 1 else F.array().cast("array<int>"), F.array(F.lit(0)), step)
    whole = F.size("_pool") >= views
    cameras = F.when(whole, F.transform(order, lambda k: F.struct(*[F.get(F.col("_pool"), k)[c].alias(c) for c in ("x", "y", "z", "clearance")])))
    fault = F.when(~whole, F.lit("too few poses" if relaxed else "too few poses of that clearance"))
    return pooled.select(key, fault.alias("fault"), "fell_back", (whole & (F.col("_enough") < views)).alias("below_clearance"), cameras.alias("cameras"))


def location_faults(cameras: Column, low: Column, high: Column, views: int) -> Column:
    """What is wrong with a room's chosen cameras: their number, points alike in seven decimals, one outside the bounds (arrays of three)."""
    alike = F.size(F.array_distinct(F.transform(cameras, lambda c: F.struct(*[F.bround(c[d], 7).alias(d) for d in "xyz"]))))
    out = lambda c: ~F.coalesce(F.lit(True) & F.array_min(F.array(*[(c[d] >= low[i] - 1e-7) & (c[d] <= high[i] + 1e-7) & ~F.isnan(c[d]) for i, d in enumerate("xyz")])), F.lit(False))
    return F.array_compact(F.array(F.when(F.size(cameras) != views, "count"), F.when(alike != F.size(cameras), "repeated"), F.when(F.exists(cameras, out), "outside")))
