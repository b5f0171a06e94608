"""Queries of the shape, curation and scene operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C, scenes as S, shapes as P
from . import views as V
from .scoring import rounded
from .views import VIEW_SQL, table


def _pairs(spark, sf):
    p = V.points(spark, sf)
    return p.select("obj_id", F.col("cloud").alias("pred")).join(p.select((F.col("obj_id") - 1).alias("obj_id"), F.col("cloud").alias("truth")), "obj_id")


def _scores(spark, sf, how):
    pairs = P.normalized(_pairs(spark, sf), "pred", "truth", how)
    near = pairs.select("obj_id", P.nearest(F.col("pred"), F.col("truth")).alias("forth"), P.nearest(F.col("truth"), F.col("pred")).alias("back"))
    return rounded(near.select("obj_id", P.chamfer(F.col("forth"), F.col("back")).alias("chamfer"), P.fscore(F.col("forth"), F.col("back"), 0.25).alias("fscore")), "chamfer", "fscore")


def chamfer_fscore(spark, sf):
    return _scores(spark, sf, "none")


def normalize_unit(spark, sf):
    return _scores(spark, sf, "unit")


def normalize_canonical(spark, sf):
    return _scores(spark, sf, "canonical")


def scene_relations(spark, sf):
    return S.touching(V.gt_objects(spark, sf))


def _ringed(spark, sf):
    """An L-shaped contour per scene with a true layout, with floor, ceiling and a camera inside."""
    b = F.col("gt_layout")
    at = lambda x, y: F.array(x, y)
    x, y = b["x1"], b["y1"]
    ring = F.array(at(F.lit(0.0), F.lit(0.0)), at(x, F.lit(0.0)), at(x, y / 2), at(x / 2, y / 2), at(x / 2, y), at(F.lit(0.0), y))
    return V.scenes(spark, sf).where("gt_layout is not null").select("sample_id", ring.alias("ring"), b["z0"].alias("floor_z"), b["z1"].alias("ceiling_z"), (x / 4).alias("cx"), (y / 4).alias("cy"))


def wall_boxes(spark, sf):
    out = S.walls(_ringed(spark, sf).drop("cx", "cy")).drop("edge").withColumnRenamed("length", "wall_length")
    return rounded(out, "cx", "cy", "cz", "wall_length", "height", "ax", "ay")


def column_ray_min(spark, sf):
    return rounded(S.ray_ranges(_ringed(spark, sf), "sample_id", 8), "distance")


def camera_grid(spark, sf):
    rooms = V.scenes(spark, sf).where("gt_layout is not null").select("sample_id", F.col("gt_layout.x0").alias("x0"), F.col("gt_layout.y0").alias("y0"), F.col("gt_layout.x1").alias("x1"), F.col("gt_layout.y1").alias("y1"))
    return rounded(S.camera_grid(rooms, 5, 0.25).select("sample_id", "ix", "iy", "px", "py"), "px", "py")


def split_summary(spark, sf):
    return C.split_summary(V.rooms(spark, sf))


def house_leak_check(spark, sf):
    return C.room_faults(V.rooms(spark, sf))


def _policy(spark, sf):
    rooms = V.rooms(spark, sf)
    reason = F.when(F.col("house_id") % 50 != 7, "not complete").otherwise("")
    return rooms.where("status = 'P'").select("room_id", (F.col("house_id") + (F.col("house_id") % 40 == 1).cast("int")).alias("house_id"), "split", reason.alias("reason"))


def exclusion_apply(spark, sf):
    return C.split_summary(C.exclude(V.rooms(spark, sf), _policy(spark, sf)))


def policy_check(spark, sf):
    return C.policy_faults(V.rooms(spark, sf), _policy(spark, sf))


def unrendered_rooms(spark, sf):
    """Frames are events of a user, who stands for a room; every 7th frame is empty."""
    frames = table(spark, sf, "events").select(F.col("user_id").alias("room_id"), F.col("event_id").alias("frame"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(10).alias("bytes"))
    rooms = table(spark, sf, "customer").select(F.col("c_custkey").alias("room_id"))
    return C.unrendered(rooms, frames)


def house_disjoint_split(spark, sf):
    return C.house_disjoint_split(V.rooms(spark, sf)).groupBy("split").agg(F.count("*").alias("rooms"), F.countDistinct("house_id").alias("houses"))


def _categories(spark, sf):
    items = table(spark, sf, "lineitem")
    category = F.concat(F.col("l_returnflag"), (F.col("l_partkey") % 9).cast("string"), F.lit("/"), F.col("l_linestatus"))
    title = F.concat(F.lit("t"), (F.col("l_suppkey") % 5).cast("string"))
    return items.select(category.alias("category"), title.alias("title"), (F.col("l_orderkey") * 100 + F.col("l_suppkey")).alias("ordinal"))


def category_majority_title(spark, sf):
    return C.majority_title(_categories(spark, sf))


def class_frequency_tail(spark, sf):
    return C.tail_to_other(_categories(spark, sf), 2200)


def _edges(spark, sf):
    e = table(spark, sf, "lineitem")
    model = F.array(1 + F.col("l_quantity") / 50, 1 + F.col("l_discount") * 3, 1 + F.col("l_tax") * 5)
    stretch = 1.5 + (F.col("l_partkey") % 5).cast("double") / 20
    return e.select(F.col("l_orderkey").alias("room"), model.alias("model"), F.transform(model, lambda x: x * stretch).alias("real"))


def room_scale_median_mad(spark, sf):
    return rounded(C.room_scale(_edges(spark, sf)), "scale", "spread")


def mask_rle(spark, sf):
    """A row of pixels per user: events in order of time, on where the value is above 50."""
    pixels = table(spark, sf, "events").select(F.col("user_id").alias("mask"), F.col("event_id").alias("pos"), (F.col("value") > 50).cast("int").alias("on"))
    runs = S.mask_runs(pixels, "mask")
    return runs.select("mask", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


def coco_renumber(spark, sf):
    images = table(spark, sf, "orders").select((F.col("o_orderkey") % 3).alias("part"), F.col("o_orderkey").alias("image_id"), "o_orderdate")
    notes = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).select((F.col("l_orderkey") % 3).alias("part"), F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ann_id"))
    _, out = S.renumber(images, notes, [F.col("part"), F.col("image_id")], [F.col("new_image_id"), F.col("ann_id")])
    return out.select("part", "image_id", "ann_id", F.col("new_image_id").cast("long").alias("new_image_id"), F.col("new_ann_id").cast("long").alias("new_ann_id"))


QUERIES = {f.__name__: f for f in (
    chamfer_fscore, normalize_unit, normalize_canonical, scene_relations, wall_boxes, column_ray_min, camera_grid, split_summary, house_leak_check, exclusion_apply,
    policy_check, unrendered_rooms, house_disjoint_split, category_majority_title, class_frequency_tail, room_scale_median_mad, mask_rle, coco_renumber,
)}

_POINT = """p AS (SELECT vec_id AS id, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z
  FROM embeddings, range(0, 21) r(i))"""
_UNIT = ", c AS (SELECT id, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS s FROM p GROUP BY id)"
_CANON = _UNIT.replace("avg(x)", "(min(x) + max(x)) / 2").replace("avg(y)", "(min(y) + max(y)) / 2").replace("avg(z)", "(min(z) + max(z)) / 2")


def _cloud_sql(extra: str, pred: str, truth: str) -> str:
    """pred, truth: SELECTs of obj_id, i, x, y, z."""
    return f"""WITH {_POINT}{extra}, a AS ({pred}), b AS ({truth}), d AS (
  SELECT a.obj_id, a.i AS ai, b.i AS bi, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d FROM a JOIN b USING (obj_id)
), f AS (SELECT obj_id, avg(m) AS mean, avg((m <= 0.0625)::INT) AS share FROM (SELECT obj_id, ai, min(d) AS m FROM d GROUP BY ALL) GROUP BY 1
), g AS (SELECT obj_id, avg(m) AS mean, avg((m <= 0.0625)::INT) AS share FROM (SELECT obj_id, bi, min(d) AS m FROM d GROUP BY ALL) GROUP BY 1)
SELECT obj_id, round(f.mean + g.mean, 6) AS chamfer, round(CASE WHEN f.share + g.share > 0 THEN 2 * f.share * g.share / (f.share + g.share) ELSE 0 END, 6) AS fscore FROM f JOIN g USING (obj_id)"""


_scaled = lambda key: f"SELECT p.id{key} AS obj_id, i, (x - ox) / s AS x, (y - oy) / s AS y, (z - oz) / s AS z FROM p JOIN c ON c.id = p.id"
_RING = """ring AS (SELECT sample_id, x, y, z, x / 4 AS cx, y / 4 AS cy, e, [0, x, x, x / 2, x / 2, 0][e + 1] AS px, [0, 0, y / 2, y / 2, y, y][e + 1] AS py,
  [0, x, x, x / 2, x / 2, 0][(e + 1) % 6 + 1] AS qx, [0, 0, y / 2, y / 2, y, y][(e + 1) % 6 + 1] AS qy FROM scene, range(0, 6) r(e) WHERE has_gt)"""
_CATEGORY = """c AS (SELECT l_returnflag || l_partkey % 9 || '/' || l_linestatus AS category, 't' || l_suppkey % 5 AS title, l_orderkey * 100 + l_suppkey AS ordinal FROM lineitem)"""
_POLICY = "policy AS (SELECT room_id, house_id, split FROM room WHERE status = 'P')"
_views = f"WITH {VIEW_SQL}"
_grown = lambda k: f"(({k}0 + {k}1) / 2 - greatest({k}1 - {k}0 + {S.EXPAND}::DOUBLE, 0.01::DOUBLE) / 2) AS {k}0, (({k}0 + {k}1) / 2 + greatest({k}1 - {k}0 + {S.EXPAND}::DOUBLE, 0.01::DOUBLE) / 2) AS {k}1"

ORACLE_SQL = {
    "chamfer_fscore": _cloud_sql("", "SELECT id AS obj_id, i, x, y, z FROM p", "SELECT id - 1 AS obj_id, i, x, y, z FROM p"),
    "normalize_unit": _cloud_sql(_UNIT, "SELECT p.id AS obj_id, i, (x - ox) / s AS x, (y - oy) / s AS y, (z - oz) / s AS z FROM p JOIN c ON c.id = p.id + 1", _scaled(" - 1")),
    "normalize_canonical": _cloud_sql(_CANON, _scaled(""), _scaled(" - 1")),
    "scene_relations": f"{_views}, g AS (SELECT sample_id, obj_idx, {_grown('x')}, {_grown('y')}, {_grown('z')} FROM gt) SELECT a.sample_id, a.obj_idx AS source, b.obj_idx AS target FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.obj_idx < b.obj_idx AND "
    + " AND ".join(f"least(a.{k}1, b.{k}1) > greatest(a.{k}0, b.{k}0)" for k in "xyz"),
    "wall_boxes": f"{_views}, {_RING}, w AS (SELECT *, sqrt((qx - px) ** 2 + (qy - py) ** 2) AS len FROM ring) SELECT sample_id, round((px + qx) / 2, 6) AS cx, round((py + qy) / 2, 6) AS cy, round(z / 2, 6) AS cz, round(len, 6) AS wall_length, {S.WALL}::DOUBLE AS thickness, round(z, 6) AS height, round((qx - px) / len, 6) AS ax, round((qy - py) / len, 6) AS ay FROM w",
    "column_ray_min": f"""{_views}, {_RING}, u AS (SELECT *, cos((col + 0.5::DOUBLE) * pi() / 4) AS ux, sin((col + 0.5::DOUBLE) * pi() / 4) AS uy FROM ring, range(0, 8) r(col)),
v AS (SELECT *, ux * (qy - py) - uy * (qx - px) AS crs FROM u),
h AS (SELECT *, ((px - cx) * (qy - py) - (py - cy) * (qx - px)) / crs AS t, ((px - cx) * uy - (py - cy) * ux) / crs AS s2 FROM v WHERE abs(crs) > 1e-12)
SELECT sample_id, col::INT AS col, round(min(t) FILTER (t >= 0 AND s2 >= 0 AND s2 <= 1), 6) AS distance FROM h GROUP BY ALL""",
    "camera_grid": f"{_views} SELECT sample_id, ix::INT AS ix, iy::INT AS iy, round(0.25::DOUBLE + (x - 0.5::DOUBLE) * ix / 4, 6) AS px, round(0.25::DOUBLE + (y - 0.5::DOUBLE) * iy / 4, 6) AS py FROM scene, range(0, 5) a(ix), range(0, 5) b(iy) WHERE has_gt",
    "split_summary": f"{_views} SELECT split, count(*) AS rooms, count(DISTINCT house_id) AS houses, sum(views)::BIGINT AS panoramas FROM room GROUP BY 1",
    "house_leak_check": f"{_views} SELECT house_id::VARCHAR AS key, 'house in several splits' AS fault FROM room GROUP BY house_id HAVING count(DISTINCT split) > 1",
    "exclusion_apply": f"{_views}, {_POLICY} SELECT split, count(*) AS rooms, count(DISTINCT house_id) AS houses, sum(views)::BIGINT AS panoramas FROM room WHERE room_id NOT IN (SELECT room_id FROM policy) GROUP BY 1",
    "policy_check": f"{_views} SELECT room_id, CASE WHEN house_id % 40 = 1 THEN 'another house' ELSE 'no reason' END AS fault FROM room WHERE status = 'P' AND (house_id % 40 = 1 OR house_id % 50 = 7)",
    "unrendered_rooms": "SELECT c_custkey AS room_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_id % 7 <> 0 GROUP BY 1 HAVING count(DISTINCT event_id) >= 4)",
    "house_disjoint_split": f"""{_views}, h AS (SELECT house_id, count(*) AS n FROM room GROUP BY 1),
o AS (SELECT house_id, (sum(n) OVER (ORDER BY md5('0:' || house_id), house_id) - n)::DOUBLE / (SELECT sum(n) FROM h) AS share FROM h),
s AS (SELECT house_id, CASE WHEN share < 0.15 THEN 'val' WHEN share < 0.3 THEN 'test' ELSE 'train' END AS split FROM o)
SELECT s.split, count(*) AS rooms, count(DISTINCT house_id) AS houses FROM room JOIN s USING (house_id) GROUP BY 1""",
    "category_majority_title": f"WITH {_CATEGORY}, g AS (SELECT category, title, count(*) AS n, min(ordinal) AS f FROM c GROUP BY ALL) SELECT category, title, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, f) AS r FROM g) WHERE r = 1",
    "class_frequency_tail": f"""WITH {_CATEGORY}, h AS (SELECT split_part(category, '/', 1) AS head, count(*) AS n FROM c GROUP BY 1)
SELECT CASE WHEN n >= 2200 THEN head ELSE 'other' END AS "class", sum(n)::BIGINT AS n FROM h GROUP BY 1""",
    "room_scale_median_mad": """WITH e AS (SELECT l_orderkey AS room, list_sort([1 + l_quantity / 50, 1 + l_discount * 3, 1 + l_tax * 5]) AS m, 1.5::DOUBLE + (l_partkey % 5)::DOUBLE / 20 AS k FROM lineitem),
r AS (SELECT room, x * k / x AS ratio FROM (SELECT room, k, unnest(m) AS x FROM e)), s AS (SELECT room, median(ratio) AS scale FROM r GROUP BY 1),
d AS (SELECT room, scale, avg(abs(ratio - scale)) / scale AS spread FROM r JOIN s USING (room) GROUP BY room, scale)
SELECT room, n, round(scale, 6) AS scale, round(spread, 6) AS spread, n >= 2 AND spread <= 0.15 AS accepted FROM d JOIN (SELECT l_orderkey AS room, count(*) AS n FROM lineitem GROUP BY 1) USING (room)""",
    "mask_rle": """WITH p AS (SELECT user_id AS mask, event_id AS pos, (value > 50)::INT AS o FROM events),
c AS (SELECT *, (o <> lag(o, 1, 0) OVER (PARTITION BY mask ORDER BY pos))::INT AS ch FROM p),
r AS (SELECT *, sum(ch) OVER (PARTITION BY mask ORDER BY pos) AS run FROM c),
n AS (SELECT mask, run, count(*) AS n FROM r GROUP BY ALL)
SELECT mask, CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY run) AS counts FROM n GROUP BY 1""",
    "coco_renumber": """WITH i AS (SELECT o_orderkey % 3 AS part, o_orderkey AS image_id, row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) AS new_image_id FROM orders),
a AS (SELECT DISTINCT l_orderkey % 3 AS part, l_orderkey AS image_id, l_linenumber AS ann_id FROM lineitem)
SELECT part, image_id, ann_id, new_image_id, row_number() OVER (ORDER BY new_image_id, ann_id) AS new_ann_id FROM a JOIN i USING (part, image_id)""",
}
