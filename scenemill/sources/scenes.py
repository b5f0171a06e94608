"""Manifests, ground truth and predictions as tables.

A box is read into one wide struct that holds either form; `oriented` and `aligned` turn it into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.boxes import as_oriented, box, sanitized

BOX = "struct<min_corner:array<double>,max_corner:array<double>,center:array<double>,size:array<double>,basis:array<array<double>>>"
OBJECT = f"struct<object_id:string,label:string,score:double,bbox:{BOX},attributes:map<string,string>>"
RELATION = "struct<source_id:string,target_id:string,relation_type:string,score:double>"
SCENE = f"layout {BOX}, objects array<{OBJECT}>, relations array<{RELATION}>, metadata map<string,string>"
RECORD = "sample_id string, input string, ground_truth string, metadata map<string,string>"
JSON = {"allowNonNumericNumbers": "true"}


def _need(value: Column, message: Column) -> Column:
    return F.when(value.isNull(), F.raise_error(message).cast("string")).otherwise(value)


def resolved(folder: str, path: Column) -> Column:
    return F.when(path.rlike("^(/|[a-z0-9]+:)"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def plain(path: Column) -> Column:
    """A path without scheme or doubled slashes, to compare listings with manifests."""
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:(//)?", ""), "/+", "/")


def decoded(df: DataFrame, text: str) -> DataFrame:
    """Add layout, objects, relations, metadata from a column of scene JSON; scores default to 1, lists to empty."""
    scene = F.from_json(F.col(text), SCENE, JSON)
    fill = lambda o: o.withField("score", F.coalesce(o["score"], F.lit(1.0)))
    df = df.withColumn("_s", scene)
    return df.select(
        *[c for c in df.columns if c != "_s"],
        F.col("_s.layout").alias("layout"),
        F.transform(F.coalesce("_s.objects", F.array().cast(f"array<{OBJECT}>")), fill).alias("objects"),
        F.transform(F.coalesce("_s.relations", F.array().cast(f"array<{RELATION}>")), fill).alias("relations"),
        F.col("_s.metadata").alias("scene_metadata"),
    )


def read_manifest(spark: SparkSession, path: str, check_inputs: bool = True) -> DataFrame:
    """sample_id, ordinal, input, metadata, gt (scene JSON or null). Blank lines are skipped; an absent key or input is an error."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).where(F.trim("value") != "")
    at = F.concat(F.lit("manifest line after row "), F.col("ordinal").cast("string"), F.lit(": "))
    r = lines.withColumn("r", F.from_json("value", RECORD, JSON)).select(
        _need(F.col("r.sample_id"), F.concat(at, F.lit("sample_id is missing"))).alias("sample_id"), "ordinal",
        resolved(folder, _need(F.col("r.input"), F.concat(at, F.lit("input is missing")))).alias("input"),
        F.col("r.metadata").alias("metadata"), F.col("r.ground_truth").alias("truth"),
    )
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(plain(F.col("path")).alias("_path"))
    if check_inputs:
        r = r.join(listed.withColumn("_there", F.lit(True)), plain(F.col("input")) == F.col("_path"), "left")
        r = r.withColumn("input", F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("input does not exist: "), F.col("input"))).cast("string")).otherwise(F.col("input"))).drop("_path", "_there")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(plain(F.col("_metadata.file_path")).alias("_path"), F.col("value").alias("_body"))
    inline = F.ltrim("truth").startswith("{")
    r = r.withColumn("_want", F.when(~inline, plain(resolved(folder, F.col("truth"))))).join(files, F.col("_want") == F.col("_path"), "left")
    missing = F.when(F.col("_want").isNotNull() & F.col("_body").isNull(), F.raise_error(F.concat(F.lit("ground truth does not exist: "), F.col("truth"))).cast("string"))
    return r.select("sample_id", "ordinal", "input", "metadata", F.coalesce(missing, F.when(inline, F.col("truth")).otherwise(F.col("_body"))).alias("gt"))


def read_predictions(spark: SparkSession, folder: str, samples: DataFrame) -> DataFrame:
    """sample_id, prediction (scene JSON) of each sample from <folder>/<sample_id>.json; an absent file is an error."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    root = plain(F.lit(folder.rstrip("/") + "/"))
    named = files.select(F.regexp_replace(F.replace(plain(F.col("_metadata.file_path")), root, F.lit("")), r"\.json$", "").alias("sample_id"), F.col("value").alias("prediction"))
    joined = samples.select("sample_id").join(named, "sample_id", "left")
    return joined.withColumn("prediction", _need(F.col("prediction"), F.concat(F.lit("no prediction for "), F.col("sample_id"))))


def match_outputs(samples: DataFrame, outputs: DataFrame) -> DataFrame:
    """sample_id, prediction from pos, value (scene JSON): matched by id, in the metadata or at the top; the last of an id counts."""
    named = outputs.withColumn("sample_id", F.coalesce(F.get_json_object("value", "$.metadata.sample_id"), F.get_json_object("value", "$.sample_id")))
    last = named.groupBy("sample_id").agg(F.max_by("value", "pos").alias("prediction"))
    joined = samples.select("sample_id").join(last, "sample_id", "left")
    lost = [r[0] for r in joined.where("prediction is null").select("sample_id").orderBy("sample_id").limit(5).collect()]
    if lost:
        raise ValueError(f"no output for {', '.join(lost)}")
    return joined


def aligned(b: Column) -> Column:
    """The axis-aligned form, null for an oriented box; corners out of order are an error."""
    low, high = b["min_corner"], b["max_corner"]
    wrong = F.exists(F.zip_with(low, high, lambda x, y: ~F.isnan(x) & ~F.isnan(y) & (x > y)), lambda v: v)
    made = box(low[0], low[1], low[2], high[0], high[1], high[2])
    return F.when(low.isNotNull(), F.when(wrong, F.raise_error(F.lit("a box's least corner lies beyond its greatest")).cast(made_type)).otherwise(made))


made_type = "struct<x0:double,y0:double,z0:double,x1:double,y1:double,z1:double>"


def oriented(b: Column) -> Column:
    """Centre, size and axes of either form; without axes, those of the frame."""
    axes = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    given = F.struct(b["center"].alias("center"), b["size"].alias("size"), F.coalesce(b["basis"], axes).alias("basis"))
    return F.when(b["center"].isNotNull(), sanitized(given)).otherwise(as_oriented(aligned(b)))


def either(b: Column) -> Column:
    """The corners of an axis-aligned box and, under `turned`, the oriented form of an oriented one; null for no box."""
    flat, form = aligned(b), b["center"].isNotNull()
    sides = [F.when(~form, flat[n]).alias(n) for n in ("x0", "y0", "z0", "x1", "y1", "z1")]
    return F.when(form | flat.isNotNull(), F.struct(*sides, F.when(form, oriented(b)).alias("turned")))


def shape_of(attributes: Column) -> tuple[Column, Column]:
    """(points, path) of an object's `shape`: points in place, in a list or under `points`, or a file's name, bare or under `file`, `mesh` or `path`."""
    text = F.trim(attributes["shape"])
    listed = F.when(text.startswith("["), text).when(text.startswith("{"), F.get_json_object(text, "$.points"))
    named = F.when(text.startswith("{"), F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ("file", "mesh", "path")])).when(~text.startswith("["), text)
    return F.from_json(listed, "array<array<double>>", JSON), F.when(listed.isNull(), named)


def objects(scenes: DataFrame) -> DataFrame:
    """sample_id, obj_idx, object_id, label, score, bbox, attributes."""
    return scenes.select("sample_id", F.posexplode("objects").alias("obj_idx", "o")).select("sample_id", "obj_idx", "o.*")


def relations(scenes: DataFrame) -> DataFrame:
    return scenes.select("sample_id", F.posexplode("relations").alias("rel_idx", "r")).select("sample_id", "rel_idx", "r.*")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
