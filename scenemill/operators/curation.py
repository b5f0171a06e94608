"""Rooms, splits, exclusions, scales and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import in_order, running

SPLITS = ("train", "val", "test")
CEILING = 2.6
# plausible metric rooms: least contour ratio, ratio that asks for review, least and greatest area and extent
RATIO_REJECT, RATIO_REVIEW, AREA, EXTENT = 0.5, 1.5, (1.0, 200.0), (0.8, 30.0)


def room_faults(rooms: DataFrame) -> DataFrame:
    """key, fault of every breach: a room listed twice, an unknown split, a house in more than one split."""
    twice = rooms.groupBy(F.col("room_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("duplicate room").alias("fault"))
    unknown = rooms.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select(F.col("room_id").alias("key"), F.lit("unknown split").alias("fault"))
    leaks = rooms.groupBy(F.col("house_id").cast("string").alias("key")).agg(F.countDistinct("split").alias("n")).where("n > 1").select("key", F.lit("house in several splits").alias("fault"))
    return twice.unionByName(unknown).unionByName(leaks)


def split_summary(rooms: DataFrame) -> DataFrame:
    return rooms.groupBy("split").agg(F.count("*").alias("rooms"), F.countDistinct("house_id").alias("houses"), F.sum("views").alias("panoramas"))


def exclude(rooms: DataFrame, policy: DataFrame) -> DataFrame:
    """Rooms that the policy does not name."""
    return rooms.join(policy.select("room_id"), "room_id", "left_anti")


def policy_faults(rooms: DataFrame, policy: DataFrame) -> DataFrame:
    """room_id, fault of policy rows that name no room, another house or split, or no reason."""
    known = rooms.select("room_id", F.col("house_id").alias("h"), F.col("split").alias("s"))
    fault = (
        F.when(F.col("h").isNull(), "unknown room").when(F.col("house_id") != F.col("h"), "another house").when(F.col("split") != F.col("s"), "another split")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
    )
    return policy.join(known, "room_id", "left").select("room_id", fault.alias("fault")).where("fault is not null")


def unrendered(rooms: DataFrame, renders: DataFrame, views: int = 4) -> DataFrame:
    """Rooms without `views` usable frames. renders: room_id, frame, bytes."""
    usable = renders.where("bytes > 0").groupBy("room_id").agg(F.countDistinct("frame").alias("n")).where(F.col("n") >= views)
    return rooms.join(usable, "room_id", "left_anti")


def house_disjoint_split(rooms: DataFrame, val: float = 0.15, test: float = 0.15, seed: int = 0) -> DataFrame:
    """room_id, house_id, split: whole houses in the order of a keyed hash fill val, then test, then train.

    A house goes where the share of the rooms that stand before it falls, so a split is off by one house at
    most. Rooms before a house come from sums over partitions; houses are not gathered.
    """
    houses = rooms.groupBy("house_id").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("house_id").cast("string"))))
    placed = running(in_order(houses, [], [F.col("h"), F.col("house_id")]), [], {"upto": F.col("n")})
    total = houses.agg(F.sum("n").alias("total"))
    share = (F.col("upto") - F.col("n")) / F.col("total")
    split = F.when(share < val, "val").when(share < val + test, "test").otherwise("train")
    chosen = placed.join(F.broadcast(total)).select("house_id", split.alias("split"))  # one row
    return rooms.select("room_id", "house_id").join(chosen, "house_id")


def first_reason(*reasons: Column) -> Column:
    """The first reason of a cascade that is not null."""
    return F.coalesce(*reasons)


def resolved_scale(rooms: DataFrame, known: DataFrame) -> DataFrame:
    """Add scale and source: a table's entry before the ceiling's height. rooms: room_id, height; known: room_id, scale."""
    joined = rooms.join(known.select("room_id", F.col("scale").alias("_s")), "room_id", "left")
    checked = F.when(F.col("_s") <= 0, F.raise_error(F.lit("a scale must be positive")).cast("double")).otherwise(F.col("_s"))
    return joined.withColumn("scale", F.coalesce(checked, CEILING / F.col("height"))).withColumn("scale_source", F.when(F.col("_s").isNotNull(), "table").otherwise("ceiling")).drop("_s")


def plausibility(ratio: Column, area: Column, extent: Column) -> tuple[Column, Column]:
    """Reasons to reject and to review a metric room, as arrays."""
    reject = [F.when(ratio < RATIO_REJECT, "contour ratio"), F.when((area < AREA[0]) | (area > AREA[1]), "area"), F.when((extent < EXTENT[0]) | (extent > EXTENT[1]), "extent")]
    return F.array_compact(F.array(*reject)), F.array_compact(F.array(F.when(ratio > RATIO_REVIEW, "contour ratio")))


def room_scale(objects: DataFrame, min_objects: int = 2, max_spread: float = 0.15) -> DataFrame:
    """room, n, scale, spread, accepted from room, model, real (edge lengths): median of the ratios of sorted edges.

    The spread is the mean distance of the ratios from the median, as a share of it.
    """
    ratios = objects.select("room", F.explode(F.arrays_zip(F.sort_array("real").alias("r"), F.sort_array("model").alias("m"))).alias("z")).select("room", (F.col("z.r") / F.col("z.m")).alias("ratio"))
    scale = ratios.groupBy("room").agg(F.percentile("ratio", 0.5).alias("scale"))
    spread = ratios.join(scale, "room").groupBy("room", "scale").agg((F.avg(F.abs(F.col("ratio") - F.col("scale"))) / F.col("scale")).alias("spread"))
    counted = objects.groupBy("room").agg(F.count("*").alias("n"))
    return counted.join(spread, "room").select("room", "n", "scale", "spread", ((F.col("n") >= min_objects) & (F.col("spread") <= max_spread)).alias("accepted"))


def majority_title(titles: DataFrame) -> DataFrame:
    """category, title, n: the commonest title of each category, the first seen among equals. titles: category, title, ordinal."""
    counts = titles.groupBy("category", "title").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    best = counts.groupBy("category").agg(F.max_by(F.struct("title", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("category", "b.title", "b.n")


def tail_to_other(items: DataFrame, least: int = 100) -> DataFrame:
    """class, n: the part of the category before a slash where it has `least` items, else `other`."""
    heads = items.select(F.split_part("category", F.lit("/"), F.lit(1)).alias("head")).groupBy("head").agg(F.count("*").alias("n"))
    return heads.groupBy(F.when(F.col("n") >= least, F.col("head")).otherwise("other").alias("class")).agg(F.sum("n").alias("n"))


def mean_sizes(sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """class, size of every class; one without a size gets the mean of the others' means."""
    means = sizes.groupBy("class").agg(F.avg("size").alias("size"))
    overall = means.agg(F.avg("size").alias("_all"))
    return classes.join(means, "class", "left").join(F.broadcast(overall)).select("class", F.coalesce("size", "_all").alias("size"))


def spread_sample(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """First, middle and last row of each group."""
    w, all_of = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    at, n = F.col("_at"), F.col("_n")
    marked = rows.withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count("*").over(all_of))
    return marked.where((at == 1) | (at == F.floor(n / 2) + 1) | (at == n)).drop("_at", "_n")
