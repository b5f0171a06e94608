"""The validator of a derived dataset: every fault as a row, from one pass over each of its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import SIZE, VIEWS, expected_views
from .curation import SPLITS
from .scenes import annotation_faults

SOURCES = ("rgb", "gt", "coco", "dpc")


def _faults(df: DataFrame, split: str, key: str, *named: tuple[str, Column]) -> DataFrame:
    """split, id, fault for each condition that holds; one that is null does not."""
    return df.select(F.col(split).alias("split"), F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))).alias("fault"))


def _repeated(df: DataFrame, keys: list[str], shown: str, fault: str) -> DataFrame:
    """A fault for each key that more than one row has. Keys alone are shuffled, counted first where they are."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return many.select("split" if "split" in keys else F.lit(None).cast("string").alias("split"), F.col(shown).cast("string").alias("id"), F.lit(fault).alias("fault"))


def sample_faults(rooms: DataFrame, rgb: DataFrame, gt: DataFrame, images: DataFrame, mapping: DataFrame, views: int = VIEWS) -> DataFrame:
    """What the sets of samples lack or have too much of, and where their paths disagree.

    The expected samples and the four sets are one long table, grouped once by split and sample: no set is joined to another.
    """
    none = F.lit(None).cast("string")
    row = lambda df, source, a=none, b=none: df.select("split", "sample_id", F.lit(source).alias("source"), a.alias("a"), b.alias("b"))
    long = reduce(DataFrame.unionByName, [
        row(expected_views(rooms.select("split", "room_id").distinct(), views), "want"), row(rgb, "rgb", F.col("input"), F.col("meta_split")), row(gt, "gt", F.col("input"), F.col("ground_truth")),
        row(images.where("frame = 0"), "coco"), row(images.where("frame <> 0"), "turned"), row(mapping.where(F.col("split").isin(*SPLITS)), "dpc", F.col("input"), F.col("ground_truth")),
    ])
    of = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c))).alias(f"{source}_{c}")
    held = long.groupBy("split", "sample_id").agg(
        *[F.count_if(F.col("source") == s).alias(s) for s in ("want", "turned", *SOURCES)], *[of(s, c) for s in ("rgb", "gt", "dpc") for c in ("a", "b")]
    )
    sets = [
        (f"{s}: {what}", test) for s in SOURCES for what, test in (
            ("missing", (F.col("want") > 0) & (F.col(s) == 0)), ("unexpected", (F.col("want") == 0) & (F.col(s) > 0)), ("repeated", F.col(s) > 1),
        )
    ]
    return _faults(
        held, "split", "sample_id", *sets, ("coco: unexpected frame", (F.col("want") == 0) & (F.col("turned") > 0)), ("rgb split", F.col("rgb_b") != F.col("split")),
        ("rgb and gt paths", F.col("rgb_a") != F.col("gt_a")), ("dpc source", (F.col("dpc_a") != F.col("rgb_a")) | (F.col("dpc_b") != F.col("gt_b"))),
    )


def dataset_faults(
    rooms: DataFrame, excluded: DataFrame, listed: DataFrame, rgb: DataFrame, gt: DataFrame, pictures: DataFrame, images: DataFrame, annotations: DataFrame,
    categories: DataFrame, mapping: DataFrame, paths: DataFrame, classes: list[str], views: int = VIEWS, size: tuple[int, int] = SIZE,
) -> DataFrame:
    """split, id, fault of everything in which a dataset is not consistent; none: it may be used.

    rooms, listed (the split texts): split, room_id. excluded: room_id. rgb: split, sample_id, input, meta_split. gt: split, sample_id,
    input, ground_truth. pictures: input, width, height (see `picture_sizes`). images: split, id, sample_id, frame, file_name, width, height.
    annotations: split, id, image_id, category_id, bbox, area, height, width, counts. categories: split, id, name, supercategory.
    mapping: split, sample_id, dpc_name, input, ground_truth. paths: split, path. Scenes are checked by `scene_faults`.
    """
    text = rooms.select("split", "room_id", F.lit(1).alias("n")).unionByName(listed.select("split", "room_id", F.lit(-1).alias("n"))).groupBy("split", "room_id").agg(F.sum("n").alias("n"))
    seen = rgb.join(pictures.select("input", F.col("width").alias("_w"), F.col("height").alias("_h")), "input", "left").select("split", "sample_id", "input", "_w", "_h")
    drawn = images.join(seen.dropDuplicates(["split", "sample_id"]), ["split", "sample_id"], "left")
    turned = F.concat(F.regexp_replace("input", r"\.[^./]*$", ""), F.lit(".frame"), F.col("frame").cast("string"), F.lit(".png"))
    place = F.when(F.col("frame") == 0, F.col("input")).otherwise(turned)
    known = images.select("split", F.col("id").alias("image_id"), F.col("width").alias("_iw"), F.col("height").alias("_ih")).dropDuplicates(["split", "image_id"])
    notes = annotations.join(known, ["split", "image_id"], "left")
    wrong = annotation_faults(F.col("_iw"), F.col("_ih"), F.col("bbox"), F.col("area"), F.col("counts"))
    found = F.col("_iw").isNotNull()
    given = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("id"), F.lit(c).alias("name"), F.lit("furniture").alias("supercategory")) for i, c in enumerate(classes)])
    # a category table is as long as the list of classes
    sorts = categories.groupBy("split").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "name", "supercategory"))).alias("_c"))
    splits = rooms.select("split").distinct().join(sorts, "split", "left")
    own = mapping.where(F.col("split").isin(*SPLITS)).select("split", F.concat(F.lit("images/"), "split", F.lit("/"), "dpc_name", F.lit(".png")).alias("path"), F.lit(1).alias("n"))
    links = own.unionByName(paths.select("split", "path", F.lit(-1).alias("n"))).groupBy("split", "path").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, [
        _faults(rooms.join(excluded.select("room_id").distinct(), "room_id", "left_semi"), "split", "room_id", ("excluded room", F.lit(True))),
        _repeated(rooms.withColumn("split", F.lit(None).cast("string")), ["room_id"], "room_id", "room repeated"),
        _faults(text, "split", "room_id", ("split text", F.col("n") != 0)),
        sample_faults(rooms, rgb, gt, images, mapping, views),
        _faults(seen, "split", "sample_id", ("no picture", F.col("_w").isNull()), ("picture size", (F.col("_w") != size[0]) | (F.col("_h") != size[1]))),
        _repeated(images, ["split", "id"], "id", "image id repeated"), _repeated(images, ["split", "sample_id", "frame"], "sample_id", "image frame repeated"),
        _faults(drawn, "split", "id", ("image size", (F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h"))), ("image file", F.col("file_name") != place)),
        _repeated(annotations, ["split", "id"], "id", "annotation id repeated"),
        _faults(
            notes, "split", "id", ("annotation image", ~found), ("annotation category", ~F.col("category_id").between(1, len(classes))),
            ("annotation shape", found & ((F.col("height") != F.col("_ih")) | (F.col("width") != F.col("_iw")))),
            *[(f"annotation {w}", found & F.array_contains(wrong, w)) for w in ("box", "runs", "area")],
        ),
        _faults(splits, "split", "split", ("categories", F.coalesce(F.col("_c") != given, F.lit(True)))),
        _repeated(mapping, ["dpc_name"], "dpc_name", "dpc name repeated"),
        _faults(mapping, "split", "sample_id", ("dpc split", F.coalesce(~F.col("split").isin(*SPLITS), F.lit(True)))),
        _faults(links, "split", "path", ("dpc path", F.col("n") != 0)),
    ])
