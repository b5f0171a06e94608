"""Scenes, boxes, rooms and clouds derived by arithmetic from the supplied tables.

VIEW_SQL states each view once more for the oracle; both sides use the same arithmetic on doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.boxes import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(c) -> F.Column:
    return c.cast("double")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, gt_layout, pred_layout: a scene per order; every 23rd lacks a true layout, every 17th a predicted one."""
    k = F.col("o_orderkey")
    x, y, z = 2 + _d(k % 7) * 0.5, 2 + _d(k % 5) * 0.5, 1.5 + _d(k % 3) * 0.5
    zero, s = F.lit(0.0), _d(k % 4) / 10
    return table(spark, sf_dir, "orders").select(
        k.alias("sample_id"),
        F.when(k % 23 != 0, box(zero, zero, zero, x, y, z)).alias("gt_layout"),
        F.when(k % 17 != 0, box(s, s, zero, x + s, y + s / 2, z)).alias("pred_layout"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, z0 = _d(F.col("l_partkey") % 40) / 10, _d(F.col("l_suppkey") % 40) / 10, _d(F.col("l_linenumber") % 3) / 2
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1).alias("obj_idx"),
        F.col("l_returnflag").alias("label"), "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") / 110000, 1).alias("score"),
        x0.alias("x0"), y0.alias("y0"), z0.alias("z0"),
        (x0 + (0.5 + F.col("l_quantity") / 50)).alias("x1"), (y0 + (0.5 + F.col("l_discount") * 5)).alias("y1"), (z0 + (0.5 + F.col("l_tax") * 10)).alias("z1"),
    )


def _boxed(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, box(*[F.col(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1")]).alias("box"))


def gt_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, obj_idx, label, box: an object per line item."""
    return _boxed(_lines(spark, sf_dir), "sample_id", "obj_idx", "label")


def pred_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, obj_idx, label, score, box: the objects moved, some missing, some with another label."""
    moved = _lines(spark, sf_dir).where((F.col("sample_id") + F.col("obj_idx")) % 11 != 0)
    dx, dy = _d(F.col("l_partkey") % 7) / 10, _d(F.col("l_suppkey") % 5) / 10
    moved = moved.withColumns({"x0": F.col("x0") + dx, "x1": F.col("x1") + dx, "y0": F.col("y0") + dy, "y1": F.col("y1") + dy})
    return _boxed(moved.withColumn("label", F.when(F.col("l_partkey") % 13 == 0, "R").otherwise(F.col("label"))), "sample_id", "obj_idx", "label", "score")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj_id, label, cloud: 21 points of three numbers from each vector."""
    cloud = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.col("embedding")[(i * 3 + j).cast("int")].cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obj_id"), "label", cloud.alias("cloud"))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room_id, house_id, split, views: an order is a room of its customer's house; the split goes by house but for a few rooms."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    split = F.when((k % 501 == 0) | (c % 10 == 1), "val").when(c % 10 == 2, "test").otherwise("train")
    return table(spark, sf_dir, "orders").select(
        F.concat(c.cast("string"), F.lit("/"), k.cast("string")).alias("room_id"), c.alias("house_id"), split.alias("split"),
        (F.lit(4) - F.when(k % 29 == 0, 1).otherwise(0)).alias("views"), F.col("o_orderstatus").alias("status"),
    )


VIEW_SQL = """
scene AS (
  SELECT o_orderkey AS sample_id, o_orderkey % 23 <> 0 AS has_gt, o_orderkey % 17 <> 0 AS has_pred,
    2 + (o_orderkey % 7)::DOUBLE * 0.5::DOUBLE AS x, 2 + (o_orderkey % 5)::DOUBLE * 0.5::DOUBLE AS y,
    1.5::DOUBLE + (o_orderkey % 3)::DOUBLE * 0.5::DOUBLE AS z, (o_orderkey % 4)::DOUBLE / 10 AS s
  FROM orders
), line AS (
  SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS obj_idx,
    l_returnflag AS label, l_partkey, l_suppkey, round(l_extendedprice / 110000, 1) AS score,
    (l_partkey % 40)::DOUBLE / 10 AS x0, (l_suppkey % 40)::DOUBLE / 10 AS y0, (l_linenumber % 3)::DOUBLE / 2 AS z0,
    (l_partkey % 40)::DOUBLE / 10 + (0.5::DOUBLE + l_quantity / 50) AS x1, (l_suppkey % 40)::DOUBLE / 10 + (0.5::DOUBLE + l_discount * 5) AS y1,
    (l_linenumber % 3)::DOUBLE / 2 + (0.5::DOUBLE + l_tax * 10) AS z1
  FROM lineitem
), gt AS (
  SELECT sample_id, obj_idx, label, x0, y0, z0, x1, y1, z1 FROM line
), pred AS (
  SELECT sample_id, obj_idx, CASE WHEN l_partkey % 13 = 0 THEN 'R' ELSE label END AS label, score,
    x0 + (l_partkey % 7)::DOUBLE / 10 AS x0, y0 + (l_suppkey % 5)::DOUBLE / 10 AS y0, z0,
    x1 + (l_partkey % 7)::DOUBLE / 10 AS x1, y1 + (l_suppkey % 5)::DOUBLE / 10 AS y1, z1
  FROM line WHERE (sample_id + obj_idx) % 11 <> 0
), room AS (
  SELECT o_custkey || '/' || o_orderkey AS room_id, o_custkey AS house_id,
    CASE WHEN o_orderkey % 501 = 0 OR o_custkey % 10 = 1 THEN 'val' WHEN o_custkey % 10 = 2 THEN 'test' ELSE 'train' END AS split,
    4 - (o_orderkey % 29 = 0)::INT AS views, o_orderstatus AS status
  FROM orders
)"""


def overlap_sql(a: str, b: str) -> str:
    """Shared volume of two boxes given by prefixes such as 'g.' and 'p.'."""
    return " * ".join(f"greatest(0, least({a}{k}1, {b}{k}1) - greatest({a}{k}0, {b}{k}0))" for k in "xyz")


def volume_sql(a: str) -> str:
    return " * ".join(f"greatest(0, {a}{k}1 - {a}{k}0)" for k in "xyz")


def iou_sql(a: str, b: str) -> str:
    shared = f"({overlap_sql(a, b)})"
    union = f"({volume_sql(a)} + {volume_sql(b)} - {shared})"
    return f"(CASE WHEN {union} > 0 THEN {shared} / {union} ELSE 0 END)"
