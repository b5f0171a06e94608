"""Ground truth of views: boxes around points, classes, the camera's frame, and what is published of it.

A room's geometry and scale are worked out once, at the grain of rooms, and joined to its views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OTHER = "other"
FLAT = 1e-7


def upright_boxes(points: DataFrame, key: str) -> DataFrame:
    """key, center, size, basis of the upright box around each key's points (rows key, x, y, z).

    Its long side lies along the direction in which the footprint spreads most, turned so that x is not negative. That
    direction is half the angle of (var x - var y, 2 cov xy); of a footprint that spreads alike in all directions
    it is the x axis.
    """
    spread = points.groupBy(key).agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    turn = F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2
    axes = spread.select(key, F.cos(turn).alias("ax"), F.sin(turn).alias("ay"))
    along, across = F.col("x") * F.col("ax") + F.col("y") * F.col("ay"), F.col("y") * F.col("ax") - F.col("x") * F.col("ay")
    ends = points.join(axes, key).groupBy(key, "ax", "ay").agg(
        *[f(c).alias(f"{n}{k}") for n, c in (("u", along), ("v", across), ("z", F.col("z"))) for k, f in ((0, F.min), (1, F.max))]
    )
    mid = {n: (F.col(f"{n}0") + F.col(f"{n}1")) / 2 for n in "uvz"}
    return ends.select(
        key,
        F.array(mid["u"] * F.col("ax") - mid["v"] * F.col("ay"), mid["u"] * F.col("ay") + mid["v"] * F.col("ax"), mid["z"]).alias("center"),
        F.array(*[F.col(f"{n}1") - F.col(f"{n}0") for n in "uvz"]).alias("size"),
        F.array(F.array("ax", "ay", F.lit(0.0)), F.array(-F.col("ay"), F.col("ax"), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("basis"),
    )


def from_half_extents(center: Column, half: Column, basis: Column) -> Column:
    """An oriented box from half its edges."""
    return F.struct(center.alias("center"), F.transform(half, lambda x: x * 2).alias("size"), basis.alias("basis"))


def solid(objects: DataFrame, size: str = "size") -> DataFrame:
    """Objects none of whose edges is next to nothing."""
    return objects.where(F.array_min(size) > FLAT)


def training_classes(objects: DataFrame, table: DataFrame | None, model: str = "model") -> DataFrame:
    """Objects with `class` and `fine` by their model's row in table (model, class, fine).

    Without a table the class is the coarse `label`; with one, a model that it lacks is of class `other`.
    """
    if table is None:
        return objects.withColumns({"class": F.col("label"), "fine": F.lit(None).cast("string")})
    known = table.select(F.col(model).alias("_m"), F.col("class").alias("_c"), F.col("fine").alias("_f"))
    joined = objects.join(known, F.col(model) == F.col("_m"), "left")
    return joined.withColumns({"class": F.coalesce("_c", F.lit(OTHER)), "fine": F.col("_f")}).drop("_m", "_c", "_f")


def labels_by_file(instances: DataFrame, objects: DataFrame, file: str = "source_file", source: str = "source_glb") -> DataFrame:
    """Rendered instances of a scene with the label of the object whose file has the same name in any folder; the rest go.

    Of objects with files of one name the last counts, by obj_idx.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    labels = objects.groupBy("sample_id", name(source).alias("_file")).agg(F.max_by("label", "obj_idx").alias("label"))
    return instances.withColumn("_file", name(file)).join(labels, ["sample_id", "_file"]).drop("_file")


def in_camera(center: Column, camera: Column, scale: Column) -> Column:
    """A point of the world in metres from the camera."""
    return F.zip_with(center, camera, lambda p, c: (p - c) * scale)


def view_objects(views: DataFrame, objects: DataFrame, scales: DataFrame) -> DataFrame:
    """Every view's objects in its camera's frame: views (sample_id, room_id, camera), objects (room_id, center, size, ...), scales (room_id, scale)."""
    rooms = solid(objects).join(scales.select("room_id", "scale"), "room_id")
    placed = views.select("sample_id", "room_id", "camera").join(rooms, "room_id")
    return placed.withColumns({"center": in_camera(F.col("center"), F.col("camera"), F.col("scale")), "size": F.transform("size", lambda x: x * F.col("scale"))}).drop("camera", "scale")


def moved_layout(layout: DataFrame, camera: str, scale: str) -> DataFrame:
    """Layouts (ring, floor_z, ceiling_z, area) about the camera and in metres: lengths by the scale, areas by its square."""
    s, c = F.col(scale), F.col(camera)
    ring = F.transform("ring", lambda p: F.array((p[0] - c[0]) * s, (p[1] - c[1]) * s))
    return layout.withColumns({"ring": ring, "floor_z": (F.col("floor_z") - c[2]) * s, "ceiling_z": (F.col("ceiling_z") - c[2]) * s, "area": F.col("area") * s * s})


def published(scenes: DataFrame, dropped: tuple[str, ...] = ("shape",)) -> DataFrame:
    """Scenes without the named attributes, and without a split in the path: house/room/view."""
    kept = F.transform("objects", lambda o: o.withField("attributes", F.map_filter(o["attributes"], lambda k, _: ~k.isin(*dropped))))
    return scenes.withColumn("objects", kept).withColumn("path", F.concat("sample_id", F.lit(".json"))).drop("split")


def write_ground_truth(scenes: DataFrame, path: str) -> None:
    """A JSON line per view under <path>/scenes/split=..., and a manifest under <path>/manifests/split=... that names them."""
    scenes.write.mode("errorifexists").partitionBy("split").json(f"{path}/scenes")
    named = scenes.select("split", "sample_id", "input", F.concat(F.lit("scenes/split="), "split").alias("ground_truth"))
    named.write.mode("errorifexists").partitionBy("split").json(f"{path}/manifests")


def coco_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame, info: dict[str, str]) -> DataFrame:
    """split, section, id, line: each split's COCO document, a line for each image and annotation, in the order of section and id.

    images and annotations have split and id; categories (id, name, supercategory) are those of every split. Elements after the first of
    a list begin with the comma, so no line has to know the next one.
    """
    def listed(df: DataFrame, section: int) -> DataFrame:
        firsts = df.groupBy("split").agg(F.min("id").alias("_first"))  # a row per split
        text = F.to_json(F.struct(*[c for c in df.columns if c != "split"]))
        return df.join(F.broadcast(firsts), "split").select("split", F.lit(section).alias("section"), F.col("id").cast("long").alias("id"), F.when(F.col("id") == F.col("_first"), text).otherwise(F.concat(F.lit(","), text)).alias("line"))

    splits = images.select("split").union(annotations.select("split")).distinct()
    sorts = categories.agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name", "supercategory")))).alias("_c"))  # as long as the list of classes
    given = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in info.items()], F.col("split")))
    head = F.concat(F.lit('{"info":'), given, F.lit(',"licenses":[],"categories":'), F.col("_c"), F.lit(',"images":['))
    fixed = splits.join(F.broadcast(sorts)).select("split", F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.lit(0).cast("long").alias("id"), line.alias("line")) for n, line in ((0, head), (2, F.lit('],"annotations":[')), (4, F.lit("]}")))])).alias("f"))
    return fixed.select("split", "f.*").unionByName(listed(images, 1)).unionByName(listed(annotations, 3))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, info: dict[str, str] | None = None) -> None:
    """A COCO document per split, the one file in <path>/split=<split>. Its lines stream through a task in order; none is held whole."""
    lines = coco_lines(images, annotations, categories, info or {})
    lines.repartition("split").sortWithinPartitions("split", "section", "id").select("split", "line").write.mode("errorifexists").partitionBy("split").text(path)


def read_coco(spark: SparkSession, path: str, images: str, annotations: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of the documents that write_coco has written, by lines; images, annotations: their schemas, without split."""
    lines = spark.read.option("basePath", path).text(path).select("split", F.ltrim("value", F.lit(",")).alias("value")).where("value LIKE '{%' AND value NOT LIKE '{\"info\"%'")
    is_note = F.get_json_object("value", "$.image_id").isNotNull()
    parsed = lambda kind, test: lines.where(test).select("split", F.from_json("value", kind).alias("r")).select("split", "r.*")
    return parsed(images, ~is_note), parsed(annotations, is_note)


def merged_parts(parts: DataFrame, expected: int) -> DataFrame:
    """Rows of numbered parts (`part` from 0); a part without rows is an error, as its work is missing."""
    found = {r[0] for r in parts.select("part").distinct().limit(expected + 1).collect()}  # numbers of parts
    lost = sorted(set(range(expected)) - found)
    if lost or len(found) > expected:
        raise ValueError(f"parts {lost[:5]} are missing" if lost else "there are more parts than expected")
    return parts


def best_instance(candidates: DataFrame) -> DataFrame:
    """room, obj, ratios of the sizes that fit an object best: rows room, obj, pos, model, real (edges of both, three numbers).

    Edges are compared in order of length; the fit is the greatest ratio over the least, the first candidate among equals.
    Objects with an edge that is next to nothing are left out.
    """
    ratios = F.zip_with(F.sort_array("real"), F.sort_array("model"), lambda r, m: r / m)
    rated = candidates.where(F.array_min("model") > 1e-6).withColumn("ratios", ratios)
    bad = F.array_max("ratios") / F.greatest(F.array_min("ratios"), F.lit(1e-9))
    return rated.groupBy("room", "obj").agg(F.min_by("ratios", F.struct(bad.alias("bad"), F.col("pos"))).alias("ratios"))


def scale_of(best: DataFrame, min_objects: int = 2, max_spread: float = 0.15) -> DataFrame:
    """room, n, scale, spread, accepted from the ratios of its objects: their median, and their mean distance from it as a share."""
    flat = best.select("room", F.explode("ratios").alias("ratio"))
    scale = flat.groupBy("room").agg(F.percentile("ratio", 0.5).alias("scale"))
    spread = flat.join(scale, "room").groupBy("room", "scale").agg((F.avg(F.abs(F.col("ratio") - F.col("scale"))) / F.greatest("scale", F.lit(1e-9))).alias("spread"))
    counted = best.groupBy("room").agg(F.count("*").alias("n"))
    return counted.join(spread, "room").select("room", "n", "scale", "spread", ((F.col("n") >= min_objects) & (F.col("spread") <= max_spread)).alias("accepted"))
