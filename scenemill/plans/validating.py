"""The query of the dataset validator: a dataset of the orders, in which every fault is planted in some rooms; its SQL lists what was planted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as D
from .views import table

CLASSES = ["chair", "sofa", "table"]
_K = "o_orderkey"


def _samples(spark, sf):
    """split, room_id, k, view, sample_id, input: two views of each room."""
    rooms = _rooms(spark, sf)
    view = rooms.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("view"))
    sample = F.concat_ws("/", "room_id", F.col("view").cast("string"))
    return view.select("*", sample.alias("sample_id")).withColumn("input", F.concat(F.lit("rgb/"), "sample_id", F.lit(".png")))


def _rooms(spark, sf):
    k = F.col(_K)
    return table(spark, sf, "orders").select(k.alias("k"), k.cast("string").alias("room_id"), F.when(k % 10 == 1, "val").when(k % 10 == 2, "test").otherwise("train").alias("split"))


def dataset_faults(spark, sf):
    rooms, s, k, first = _rooms(spark, sf), _samples(spark, sf), F.col("k"), F.col("view") == 0
    twice = lambda df, c: df.select("*", F.explode(F.when(c, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    rgb = twice(s.where(~(first & (k % 101 == 0))), first & (k % 103 == 0)).select("split", F.when(first & (k % 107 == 0), F.concat("room_id", F.lit("/7"))).otherwise(F.col("sample_id")).alias("sample_id"), "input", F.when(first & (k % 109 == 0), "none").otherwise(F.col("split")).alias("meta_split"))
    truth = F.concat(F.lit("gt/"), "sample_id", F.lit(".json"))
    gt = s.where(~(first & (k % 113 == 0))).select("split", "sample_id", F.when(first & (k % 127 == 0), "elsewhere").otherwise(F.col("input")).alias("input"), truth.alias("ground_truth"))
    pictures = s.where(~(~first & (k % 131 == 0))).select("input", F.when(~first & (k % 137 == 0), 1000).otherwise(1024).alias("width"), F.lit(512).alias("height"))
    number = k * 2 + F.col("view")
    images = s.where(~(~first & (k % 139 == 0))).select(
        "split", F.when(~first & (k % 149 == 0), number - 1).otherwise(number).alias("id"), "sample_id", F.lit(0).alias("frame"), F.when(~first & (k % 151 == 0), "x.png").otherwise(F.col("input")).alias("file_name"),
        F.when(~first & (k % 137 == 0), 1000).when(~first & (k % 157 == 0), 1).otherwise(1024).alias("width"), F.lit(512).alias("height"),
    )
    turned = s.where(first & (k % 7 == 0)).select("split", (-number - 1).alias("id"), "sample_id", F.lit(1).alias("frame"), F.concat(F.lit("rgb/"), "sample_id", F.lit(".frame1.png")).alias("file_name"), F.lit(1024).alias("width"), F.lit(512).alias("height"))
    area = F.when(k % 163 == 0, 7).when(k % 167 == 0, 10).otherwise(6).cast("long")
    inner = F.when(k % 167 == 0, 10).otherwise(6)
    notes = s.where(first).select(
        "split", F.when(k % 173 == 0, F.lit(-1)).otherwise(k).alias("id"), F.when(k % 179 == 0, F.lit(-2)).otherwise(number).alias("image_id"), F.when(k % 181 == 0, 9).otherwise(1 + k % 3).alias("category_id"),
        F.array(F.when(k % 191 == 0, -1).otherwise(5), F.lit(5), F.lit(3), F.lit(3)).alias("bbox"), area.alias("area"), F.when(k % 193 == 0, 511).otherwise(512).alias("height"), F.lit(1024).alias("width"),
        F.array(F.lit(100), inner, F.lit(512 * 1024 - 100) - inner - F.when(k % 197 == 0, 1).otherwise(0)).cast("array<long>").alias("counts"),
    )
    categories = spark.createDataFrame([(x, i + 1, c, "furniture") for x in ("train", "val") for i, c in enumerate(CLASSES)] + [("test", 1, "sofa", "furniture")], "split string, id long, name string, supercategory string")
    name = F.concat(F.lit("d"), "room_id", F.lit("_"), F.col("view").cast("string"))
    mapping = s.where(~(~first & (k % 199 == 0))).select("split", "sample_id", F.when(~first & (k % 211 == 0), F.concat(F.lit("d"), "room_id", F.lit("_0"))).otherwise(name).alias("dpc_name"), F.when(~first & (k % 223 == 0), "y").otherwise(F.col("input")).alias("input"), truth.alias("ground_truth"))
    paths = s.where(~(~first & (k % 199 == 0))).select("split", F.concat(F.lit("images/"), "split", F.lit("/"), F.when(~first & (k % 227 == 0), "z").otherwise(name), F.lit(".png")).alias("path"))
    return D.dataset_faults(
        rooms, rooms.where(k % 229 == 0).select("room_id"), rooms.where(k % 233 != 0), rgb, gt, pictures, images.unionByName(turned), notes, categories, mapping, paths, CLASSES, views=2,
    )


QUERIES = {"dataset_faults": dataset_faults}

_fault = lambda test, fault, key="room || '/1'", split="split": f"SELECT {split} AS split, {key} AS id, '{fault}' AS fault FROM r WHERE {test}"

ORACLE_SQL = {
    "dataset_faults": f"""WITH r AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS room, CASE WHEN o_orderkey % 10 = 1 THEN 'val' WHEN o_orderkey % 10 = 2 THEN 'test' ELSE 'train' END AS split FROM orders),
z AS (SELECT split, CASE WHEN k % 173 = 0 THEN -1 ELSE k END AS id FROM r)
{_fault("k % 101 = 0 OR k % 107 = 0", "rgb: missing", "room || '/0'")} UNION ALL {_fault("k % 103 = 0 AND k % 107 <> 0 AND k % 101 <> 0", "rgb: repeated", "room || '/0'")}
UNION ALL {_fault("k % 107 = 0 AND k % 101 <> 0", "rgb: unexpected", "room || '/7'")} UNION ALL {_fault("k % 107 = 0 AND k % 103 = 0 AND k % 101 <> 0", "rgb: repeated", "room || '/7'")}
UNION ALL {_fault("k % 109 = 0 AND k % 101 <> 0", "rgb split", "room || CASE WHEN k % 107 = 0 THEN '/7' ELSE '/0' END")}
UNION ALL {_fault("k % 113 = 0", "gt: missing", "room || '/0'")} UNION ALL {_fault("k % 127 = 0 AND k % 113 <> 0 AND k % 101 <> 0 AND k % 107 <> 0", "rgb and gt paths", "room || '/0'")}
UNION ALL {_fault("k % 131 = 0", "no picture")} UNION ALL {_fault("k % 137 = 0 AND k % 131 <> 0", "picture size")} UNION ALL {_fault("k % 139 = 0", "coco: missing")}
UNION ALL {_fault("k % 149 = 0 AND k % 139 <> 0", "image id repeated", "(2 * k)::VARCHAR")}
UNION ALL {_fault("k % 151 = 0 AND k % 139 <> 0", "image file", "(CASE WHEN k % 149 = 0 THEN 2 * k ELSE 2 * k + 1 END)::VARCHAR")}
UNION ALL {_fault("k % 137 <> 0 AND k % 157 = 0 AND k % 139 <> 0 AND k % 131 <> 0", "image size", "(CASE WHEN k % 149 = 0 THEN 2 * k ELSE 2 * k + 1 END)::VARCHAR")}
UNION ALL {_fault("k % 179 = 0", "annotation image", "(CASE WHEN k % 173 = 0 THEN -1 ELSE k END)::VARCHAR")} UNION ALL {_fault("k % 181 = 0", "annotation category", "(CASE WHEN k % 173 = 0 THEN -1 ELSE k END)::VARCHAR")}
UNION ALL {_fault("k % 191 = 0 AND k % 179 <> 0", "annotation box", "(CASE WHEN k % 173 = 0 THEN -1 ELSE k END)::VARCHAR")} UNION ALL {_fault("k % 193 = 0 AND k % 179 <> 0", "annotation shape", "(CASE WHEN k % 173 = 0 THEN -1 ELSE k END)::VARCHAR")}
UNION ALL {_fault("k % 197 = 0 AND k % 179 <> 0", "annotation runs", "(CASE WHEN k % 173 = 0 THEN -1 ELSE k END)::VARCHAR")}
UNION ALL {_fault("(k % 163 = 0 OR k % 167 = 0) AND k % 179 <> 0", "annotation area", "(CASE WHEN k % 173 = 0 THEN -1 ELSE k END)::VARCHAR")}
UNION ALL SELECT split, id::VARCHAR, 'annotation id repeated' FROM z GROUP BY split, id HAVING count(*) > 1 UNION ALL SELECT 'test', 'test', 'categories' WHERE EXISTS (FROM r WHERE split = 'test')
UNION ALL {_fault("k % 199 = 0", "dpc: missing")} UNION ALL {_fault("k % 211 = 0 AND k % 199 <> 0", "dpc name repeated", "'d' || room || '_0'", "NULL")}
UNION ALL {_fault("k % 223 = 0 AND k % 199 <> 0", "dpc source")}
UNION ALL {_fault("k % 211 = 0 AND k % 199 <> 0", "dpc path", "'images/' || split || '/d' || room || '_0.png'")} UNION ALL {_fault("k % 211 = 0 AND k % 199 <> 0 AND k % 227 <> 0", "dpc path", "'images/' || split || '/d' || room || '_1.png'")}
UNION ALL {_fault("k % 227 = 0 AND k % 211 <> 0 AND k % 199 <> 0", "dpc path", "'images/' || split || '/d' || room || '_1.png'")} UNION ALL SELECT DISTINCT split, 'images/' || split || '/z.png', 'dpc path' FROM r WHERE k % 227 = 0 AND k % 199 <> 0
UNION ALL {_fault("k % 229 = 0", "excluded room", "room")} UNION ALL {_fault("k % 233 = 0", "split text", "room")}""",
}
