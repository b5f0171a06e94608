"""Checks of a curated dataset: what differs, what is missing, why rooms are left out, and what an audit found.

Checks return the faults as rows, so that none stops at the first; `refuse` turns faults into an error.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .curation import AREA, EXTENT, RATIO_REJECT, exclude, policy_faults, room_faults
from .filling import greedy_fill, shuffled_places
from .ranking import checkpointed, numbered

VIEWS, SIZE = 4, (1024, 512)
# fixed values: files of a room that are its shell, and audit flags that fail a room
STRUCTURAL = ("ceil", "floor", "wall", "others", "architecture")
HARD = ("floor_layout_mismatch", "camera_count_or_duplicates", "no_floor_below_camera", "no_ceiling_above_camera", "inside_furniture_bbox", "duplicate_rgb", "near_clip_exceeds_camera_clearance")


def refuse(faults: DataFrame, what: str) -> None:
    """Raise with the first five faults, if there are any."""
    first = faults.orderBy(*faults.columns).limit(5).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(", ".join(map(str, r)) for r in first))


def is_structural(path: Column) -> Column:
    """Whether a file is part of a room's shell, by its name without folder and ending."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1).isin(*STRUCTURAL)


def id_differences(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, fault: ids that are missing, unexpected, or there more than once."""
    times = found.groupBy(key).agg(F.count("*").alias("n")).join(expected.select(key).distinct().withColumn("_want", F.lit(True)), key, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return times.select(key, fault.alias("fault")).where("fault is not null")


def row_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows with a `side`: those found only and those expected only, repeated rows counted."""
    names = expected.columns
    return found.select(names).exceptAll(expected).withColumn("side", F.lit("found")).unionByName(expected.exceptAll(found.select(names)).withColumn("side", F.lit("expected")))


def room_list(names: DataFrame) -> DataFrame:
    """Distinct rooms of a list, in order, blank lines left out."""
    return names.select(F.trim("room_id").alias("room_id")).where(F.col("room_id") != "").distinct().orderBy("room_id")


def exclusions_of(missing: DataFrame, reasons: DataFrame, evidence: str) -> tuple[DataFrame, DataFrame]:
    """(exclusions, unexplained): missing rooms with the reason recorded for them, and those without one. Other reasons are not used."""
    known = reasons.where(F.trim("reason") != "").groupBy("room_id").agg(F.min("reason").alias("reason"))
    joined = missing.select("room_id").distinct().join(known, "room_id", "left")
    plan = joined.where("reason is not null").select("room_id", F.split_part("room_id", F.lit("/"), F.lit(1)).alias("house_id"), F.lit("excluded").alias("split"), "reason", F.lit(evidence).alias("evidence"))
    return plan, joined.where("reason is null").select("room_id")


def extended_policy(policy: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The policy with the exclusions that it does not name yet, so that adding them again changes nothing."""
    return policy.unionByName(exclusions.join(policy.select("room_id"), "room_id", "left_anti"))


def reviewed(rooms: DataFrame, table: DataFrame | None) -> DataFrame:
    """rooms with the first reason to leave each out, null for those that stay.

    rooms: room_id, geometry_error (or null), ratio, area, extent (the last two in metres), camera_error (or null). The cascade:
    geometry, metric scale, membership of the scale table (room_id), cameras.
    """
    scale = (
        F.when(F.col("ratio") < RATIO_REJECT, "contour ratio").when(~F.col("area").between(*AREA), "area").when(~F.col("extent").between(*EXTENT), "extent")
    )
    listed = F.lit(True)
    if table is not None:
        rooms = rooms.join(table.select("room_id", F.lit(True).alias("_in")).distinct(), "room_id", "left")
        listed = F.col("_in").isNotNull()
    reason = F.coalesce(F.concat(F.lit("geometry: "), "geometry_error"), F.concat(F.lit("scale: "), scale), F.when(~listed, "no single scale"), F.concat(F.lit("cameras: "), "camera_error"))
    return rooms.withColumn("exclusion", reason).drop("_in")


def greedy_house_split(rooms: DataFrame, val: float = 0.15, test: float = 0.15, seed: int = 0, order: str = "shuffled") -> DataFrame:
    """room_id, house_id, split: whole houses, one after the other, each to the split that lacks most (train, val, test among equals).

    order: `shuffled` is that of Python's seeded shuffle of the sorted houses, `keyed` that of a hash of seed and house. Either way
    houses are rows of many tasks; see `filling`. Rooms without a house are left out.
    """
    if not 0 < val + test < 1:
        raise ValueError("val and test must leave a share for train")
    if order not in ("shuffled", "keyed"):
        raise ValueError("an order is shuffled or keyed")
    houses = rooms.where("house_id is not null").groupBy("house_id").agg(F.count("*").alias("n"))
    if order == "shuffled":
        counted = checkpointed(numbered(houses, [F.col("house_id")], "number").withColumn("number", F.col("number") - 1))
        places = shuffled_places(rooms.sparkSession, counted.count(), seed)
        houses, by = counted.join(places, "number").drop("number"), [F.col("place")]
    else:
        by = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("house_id").cast("string"))), F.col("house_id")]
    total = houses.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    filled = greedy_fill(houses, "n", by, {"train": total * (1.0 - val - test), "val": total * val, "test": total * test}, "split")
    return rooms.select("room_id", "house_id").join(filled.select("house_id", "split"), "house_id").select("room_id", "house_id", "split")


def scene_faults(scenes: DataFrame, classes: list[str]) -> DataFrame:
    """sample_id, fault of scenes (width, height, low, high, objects of label, center, size, basis) that break a rule of the dataset."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    all_of = lambda a, test: F.coalesce((F.size(a) == 3) & F.forall(a, lambda v: number(v) & test(v)), F.lit(False))
    dot = lambda m, i, j: m[i][0] * m[j][0] + m[i][1] * m[j][1] + m[i][2] * m[j][2]

    def wrong(o: Column) -> Column:
        m = o["basis"]
        square = F.coalesce((F.size(m) == 3) & F.forall(m, lambda r: F.size(r) == 3), F.lit(False))
        right = F.lit(True)
        for i in range(3):
            for j in range(i, 3):
                want = 1.0 if i == j else 0.0
                right = right & (F.abs(dot(m, i, j) - want) <= 1e-5 + 1e-5 * want)
        good = all_of(o["center"], lambda v: F.lit(True)) & all_of(o["size"], lambda v: v > 0) & square & F.coalesce(right, F.lit(False))
        return ~(good & F.coalesce(o["label"].isin(*classes), F.lit(False)))

    box = all_of(F.col("low"), lambda v: v <= 0) & all_of(F.col("high"), lambda v: v >= 0) & F.coalesce(F.forall(F.zip_with("low", "high", lambda a, b: b > a), lambda v: v), F.lit(False))
    faults = F.array_compact(F.array(
        F.when(~F.coalesce((F.col("width") == SIZE[0]) & (F.col("height") == SIZE[1]), F.lit(False)), "image size"),
        F.when(~box, "layout"), F.when(F.exists("objects", wrong), "object"),
    ))
    return scenes.select("sample_id", F.explode(faults).alias("fault"))


def expected_views(rooms: DataFrame, views: int = VIEWS) -> DataFrame:
    """split, sample_id of every view that the rooms should have."""
    return rooms.select("split", "room_id", F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view")).select("split", F.concat("room_id", F.lit("/"), F.col("view").cast("string")).alias("sample_id"))


def category_faults(categories: DataFrame, classes: list[str]) -> DataFrame:
    """Categories whose id, name or supercategory is not what the classes' order asks for, and those that lack."""
    want = categories.sparkSession.createDataFrame([(i + 1, c, "furniture") for i, c in enumerate(classes)], "id long, name string, supercategory string")
    return row_differences(categories.select(F.col("id").cast("long").alias("id"), "name", "supercategory"), want)


def audited(rooms: DataFrame, views: DataFrame) -> DataFrame:
    """rooms (room_id, flags, ...) with the flags of their views (room_id, flags, rgb_sha256) and `geometry_pass`: no flag is a hard one.

    Views of a room with equal pictures are flagged. Flags are distinct, those of the room first, the rest in order.
    """
    seen = views.groupBy("room_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("_flags"), F.count("rgb_sha256").alias("_n"), F.count_distinct("rgb_sha256").alias("_k")
    )
    joined = rooms.join(seen, "room_id", "left")
    twice = F.when(F.col("_k") < F.col("_n"), F.array(F.lit("duplicate_rgb"))).otherwise(F.array().cast("array<string>"))
    flags = F.array_distinct(F.concat("flags", twice, F.coalesce("_flags", F.array().cast("array<string>"))))
    return joined.withColumn("flags", flags).withColumn("geometry_pass", ~F.arrays_overlap("flags", F.array(*map(F.lit, HARD)))).drop("_flags", "_n", "_k")


def flag_counts(rooms: DataFrame) -> DataFrame:
    """flag, rooms: how many rooms have each flag, a room counting once."""
    return rooms.select(F.explode(F.array_distinct("flags")).alias("flag")).groupBy("flag").agg(F.count("*").alias("rooms"))


def review_order(rooms: DataFrame, limit: int | None = None) -> DataFrame:
    """Rooms for review: failed ones, oversized objects, odd ceilings, the least filled floors first, then by id."""
    has = lambda f: F.array_contains("flags", f)
    ordered = rooms.orderBy((~F.col("geometry_pass")).desc(), has("oversized_source_object_requires_review").desc(), has("ceiling_height_requires_review").desc(), (1 - F.coalesce("fill", F.lit(1.0))).desc(), "room_id")
    return ordered if limit is None else ordered.limit(limit)


def review_sample(rooms: DataFrame, seed: int, each: int = 8) -> DataFrame:
    """`each` rooms of every split, picked by a seeded hash of their ids."""
    w = Window.partitionBy("split").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "room_id")), "room_id")
    return rooms.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# fixed values: folders of data that is derived from a split
DERIVED = ("manifests", "manifests_gt", "coco", "horizonnet", "dpc_dataset", "ground_truth", "rgb")


def apply_policy(spark: SparkSession, root: str, policy: dict, inventory: DataFrame, apply: bool = False) -> dict:
    """Leave a reviewed policy's rooms out of the split under `root`, a folder of any store; return a report. Without `apply` nothing is written.

    <root>/rooms is the original split and stays as it is; <root>/splits/<digest> gets the retained rooms, and <root>/policy names
    the digest in force. Applying a policy again changes nothing; another one, an inventory of other rooms, counts
    that do not fit, and data already derived from the split are errors.
    """
    digest = hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()
    listed = spark.createDataFrame(policy["rooms"], "room_id string, house_id string, split string, reason string, evidence string")
    refuse(id_differences(inventory, listed, "room_id"), "the inventory is not that of the policy")
    rooms = spark.read.parquet(f"{root}/rooms")
    active, target = f"{root}/policy", f"{root}/splits/{digest}"
    done = _there(spark, active)
    if done and spark.read.json(active).first()["policy_sha256"] != digest:
        raise ValueError("another policy is in force")
    if not done:
        for name in DERIVED:
            if _there(spark, f"{root}/{name}"):
                raise ValueError(f"{name} was derived from the split and must be rebuilt first")
    refuse(room_faults(rooms), "the split is not sound")
    refuse(policy_faults(rooms, listed), "the policy does not fit the split")
    retained = exclude(rooms, listed)
    counts = {"original_rooms": rooms.count(), "excluded_rooms": listed.count(), "retained_rooms": retained.count()}
    for name in ("original", "retained"):
        if counts[f"{name}_rooms"] != policy[f"expected_{name}_rooms"]:
            raise ValueError(f"the policy expects {policy[f'expected_{name}_rooms']} {name} rooms, there are {counts[f'{name}_rooms']}")
    report = {**counts, "policy_id": policy["policy_id"], "policy_sha256": digest, "expected_panoramas": counts["retained_rooms"] * policy["views_per_room"], "already_applied": done, "applied": apply or done}
    if done:
        refuse(row_differences(spark.read.parquet(target), retained), "the split in force is not the reviewed one")
    elif apply:
        retained.write.mode("overwrite").parquet(target)
        spark.createDataFrame([(digest, policy["policy_id"])], "policy_sha256 string, policy_id string").coalesce(1).write.mode("errorifexists").json(active)
    return report
