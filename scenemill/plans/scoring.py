"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import as_oriented, box, iou, volume
from ..functions.polygons import oriented_iou
from ..operators import bootstrap, matching, scene_metrics as M
from ..operators.ranking import checkpointed
from . import views as V
from .views import VIEW_SQL, iou_sql, overlap_sql, volume_sql

RENAME = {"A": "seat", "R": "table"}
THRESHOLD = 0.15
TOLERANCE = 0.05


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def box_volume(spark, sf):
    return rounded(V.gt_objects(spark, sf).select("sample_id", "obj_idx", volume(F.col("box")).alias("volume")), "volume")


def box_iou_pairs(spark, sf):
    pairs = M.object_pairs(V.gt_objects(spark, sf), V.pred_objects(spark, sf), ["sample_id", "label"])
    return rounded(pairs.select("sample_id", "label", F.col("a.obj_idx").alias("gt_idx"), F.col("b.obj_idx").alias("pred_idx"), iou(F.col("a.box"), F.col("b.box")).alias("iou")).where("iou > 0"), "iou")


def layout_iou(spark, sf):
    return rounded(M.layout_iou(V.scenes(spark, sf)), "value")


def collision_rate(spark, sf):
    return rounded(M.collision_rate(V.scenes(spark, sf), V.pred_objects(spark, sf)), "value")


def layout_violation_rate(spark, sf):
    return rounded(M.layout_violation_rate(V.scenes(spark, sf), V.pred_objects(spark, sf), TOLERANCE), "value")


def layout_penetration(spark, sf):
    return rounded(M.layout_penetration(V.scenes(spark, sf), V.pred_objects(spark, sf)), "value")


def class_protocol_filter(spark, sf):
    kept = matching.class_protocol(V.pred_objects(spark, sf), RENAME, ["seat"])
    return kept.groupBy("sample_id", "label").agg(F.count("*").alias("n"))


def score_floor(spark, sf):
    return V.pred_objects(spark, sf).where("score >= 0.5").select("sample_id", "obj_idx", "label", "score")


def match_greedy_label(spark, sf):
    found = matching.greedy_match(V.pred_objects(spark, sf), V.gt_objects(spark, sf), ["sample_id", "label"], THRESHOLD)
    return found.select("sample_id", "label", F.col("obj_idx").cast("long").alias("obj_idx"), F.col("rank").cast("long").alias("rank"), F.col("gt_idx").cast("long").alias("gt_idx"))


def match_greedy_agnostic(spark, sf):
    found = matching.greedy_match(V.pred_objects(spark, sf), V.gt_objects(spark, sf), ["sample_id"], THRESHOLD)
    return found.select("sample_id", F.col("obj_idx").cast("long").alias("obj_idx"), F.col("rank").cast("long").alias("rank"), F.col("gt_idx").cast("long").alias("gt_idx"))


def average_precision_scene(spark, sf):
    return rounded(M.object_map(V.scenes(spark, sf), V.pred_objects(spark, sf), V.gt_objects(spark, sf), THRESHOLD), "value")


def _with_truth(spark, sf):
    """Predictions in scenes that have truth; scenes of derived tables all have."""
    return V.pred_objects(spark, sf).join(V.scenes(spark, sf).select("sample_id"), "sample_id", "left_semi")


def ap_per_class(spark, sf):
    return rounded(M.dataset_map(_with_truth(spark, sf), V.gt_objects(spark, sf), THRESHOLD), "ap")


def map_dataset(spark, sf):
    classes = M.dataset_map(_with_truth(spark, sf), V.gt_objects(spark, sf), THRESHOLD)
    return rounded(classes.agg(F.count("*").alias("n_classes"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("value")), "value")


def _values(spark, sf):
    scenes, preds, labels = V.scenes(spark, sf), checkpointed(V.pred_objects(spark, sf)), checkpointed(V.gt_objects(spark, sf))  # read by each metric
    return M.long_form({
        "layout_iou_3d": M.layout_iou(scenes),
        "collision_rate": M.collision_rate(scenes, preds),
        "layout_violation_rate": M.layout_violation_rate(scenes, preds, TOLERANCE),
        "layout_penetration": M.layout_penetration(scenes, preds),
        "object_map": M.object_map(scenes, preds, labels, THRESHOLD),
    })


def metric_summary(spark, sf):
    return rounded(M.summary(_values(spark, sf)), "mean", "median")


def bootstrap_ci(spark, sf):
    values = _values(spark, sf).where("metric in ('layout_iou_3d', 'object_map')").withColumnRenamed("sample_id", "ordinal")
    return rounded(bootstrap.intervals(values), "ci_low", "ci_high")


def oriented_iou_pairs(spark, sf):
    """Predictions turned by an angle from their own keys against the upright truth."""
    gt = V.gt_objects(spark, sf).select("sample_id", F.col("obj_idx").alias("gt_idx"), "label", as_oriented(F.col("box")).alias("g"))
    turn = F.radians((F.col("sample_id") % 12 * 15 + 4).cast("double"))  # never along the axes, where shares are short decimals and round either way
    p = as_oriented(F.col("box"))
    axes = F.array(F.array(F.cos(turn), F.sin(turn), F.lit(0.0)), F.array(-F.sin(turn), F.cos(turn), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    pred = V.pred_objects(spark, sf).select("sample_id", "obj_idx", "label", F.struct(p["center"].alias("center"), p["size"].alias("size"), axes.alias("basis")).alias("p"))
    pairs = oriented_iou(gt.join(pred, ["sample_id", "label"]), "g", "p")
    return rounded(pairs.select("sample_id", "gt_idx", "obj_idx", "iou"), "iou").where("iou > 0")


QUERIES = {f.__name__: f for f in (
    box_volume, box_iou_pairs, layout_iou, collision_rate, layout_violation_rate, layout_penetration, class_protocol_filter, score_floor,
    match_greedy_label, match_greedy_agnostic, average_precision_scene, ap_per_class, map_dataset, metric_summary, bootstrap_ci, oriented_iou_pairs,
)}

LAYOUT_IOU = f"""(SELECT sample_id, CASE WHEN NOT has_gt THEN NULL WHEN NOT has_pred THEN 0.0::DOUBLE ELSE {iou_sql('g_', 'p_')} END AS value
  FROM (SELECT *, 0 AS g_x0, 0 AS g_y0, 0 AS g_z0, x AS g_x1, y AS g_y1, z AS g_z1, s AS p_x0, s AS p_y0, 0 AS p_z0, x + s AS p_x1, y + s / 2 AS p_y1, z AS p_z1 FROM scene))"""
COLLISION = f"""(SELECT sample_id, coalesce(v, 0.0) AS value FROM scene LEFT JOIN (
  SELECT a.sample_id, avg(({overlap_sql('a.', 'b.')} > 0)::INT) AS v FROM pred a JOIN pred b ON b.sample_id = a.sample_id AND a.obj_idx < b.obj_idx GROUP BY 1) USING (sample_id))"""


def _outside_sql(per_object: str) -> str:
    return f"""(SELECT sample_id, CASE WHEN has_pred THEN coalesce(v, 0.0) END AS value FROM scene LEFT JOIN (
  SELECT sample_id, avg({per_object}) AS v FROM (
    SELECT sample_id, 1 - ({overlap_sql('o.', 'l.')}) / ({volume_sql('o.')}) AS out
    FROM pred o JOIN (SELECT sample_id, s AS x0, s AS y0, 0 AS z0, x + s AS x1, y + s / 2 AS y1, z AS z1 FROM scene WHERE has_pred) l USING (sample_id)
    WHERE {volume_sql('o.')} > 0) GROUP BY 1) USING (sample_id))"""


VIOLATION, PENETRATION = _outside_sql(f"(out > {TOLERANCE}::DOUBLE + 1e-9)::INT"), _outside_sql("greatest(out, 0)")


def _match_sql(by: str) -> str:
    """Greedy matching as a recursion over ranks that carries the claimed labels; only pairs at the threshold can be claimed."""
    keys, a, b = by.split(", "), [], []
    on = lambda l, r: " AND ".join(f"{l}.{k} = {r}.{k}" for k in keys)
    g = ", ".join(f"p.{k}" for k in keys)
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, obj_idx) AS rank FROM pred
), cand AS (
  SELECT {g}, p.rank, t.obj_idx AS gi, {iou_sql('p.', 't.')} AS iou FROM ranked p JOIN gt t ON {on('p', 't')} WHERE {iou_sql('p.', 't.')} >= {THRESHOLD}::DOUBLE
), best AS (
  SELECT {by}, rank, list(gi ORDER BY iou DESC, gi DESC) AS options FROM cand GROUP BY ALL
), todo AS (
  SELECT {g}, p.rank, p.obj_idx, p.score, b.options FROM ranked p LEFT JOIN best b ON {on('p', 'b')} AND p.rank = b.rank
), walk AS (
  SELECT {by}, rank, obj_idx, score, options[1] AS gt_idx, CASE WHEN options IS NULL THEN []::BIGINT[] ELSE [options[1]] END AS taken FROM todo WHERE rank = 1
  UNION ALL
  SELECT {', '.join('t.' + k for k in keys)}, t.rank, t.obj_idx, t.score, list_filter(t.options, lambda o: NOT list_contains(w.taken, o))[1],
    CASE WHEN len(list_filter(t.options, lambda o: NOT list_contains(w.taken, o))) > 0 THEN list_append(w.taken, list_filter(t.options, lambda o: NOT list_contains(w.taken, o))[1]) ELSE w.taken END
  FROM walk w JOIN todo t ON {on('w', 't')} AND t.rank = w.rank + 1
)"""


AP_SCENE = """(SELECT sample_id, coalesce(v, 0.0) AS value FROM scene LEFT JOIN (
  SELECT sample_id, avg(coalesce(gained, 0) / n) AS v FROM (SELECT sample_id, label, count(*) AS n FROM gt GROUP BY ALL) LEFT JOIN (
    SELECT sample_id, label, sum(best) FILTER (gt_idx IS NOT NULL) AS gained FROM (
      SELECT *, max(precision) OVER (PARTITION BY sample_id, label ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM (
        SELECT *, sum((gt_idx IS NOT NULL)::INT) OVER (PARTITION BY sample_id, label ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS precision FROM walk))
    GROUP BY ALL) USING (sample_id, label) GROUP BY 1) USING (sample_id))"""
AP_CLASS = """(SELECT label, n AS n_gt, coalesce(d, 0)::BIGINT AS n_detections, coalesce(gained, 0) / n AS ap FROM (SELECT label, count(*) AS n FROM gt GROUP BY 1) LEFT JOIN (
  SELECT label, count(*) AS d, sum(best) FILTER (gt_idx IS NOT NULL) AS gained FROM (
    SELECT *, max(precision) OVER (PARTITION BY label ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM (
      SELECT *, sum((gt_idx IS NOT NULL)::INT) OVER (PARTITION BY label ORDER BY place ROWS UNBOUNDED PRECEDING) / place AS precision FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, sample_id, rank) AS place FROM walk)))
  GROUP BY 1) USING (label))"""
_plain, _walk, _any = f"WITH {VIEW_SQL}", f"WITH RECURSIVE {VIEW_SQL}, {_match_sql('sample_id, label')}", f"WITH RECURSIVE {VIEW_SQL}, {_match_sql('sample_id')}"
_value = "SELECT sample_id, round(value, 6) AS value FROM "

# the corners of each box inside the other and the points where edges cross, in order about their middle
_ORIENTED = f"""{_plain}, pair AS (
  SELECT g.sample_id, g.obj_idx AS gt_idx, p.obj_idx, g.x0, g.x1, g.y0, g.y1, (p.x0 + p.x1) / 2 AS cx, (p.y0 + p.y1) / 2 AS cy, (p.x1 - p.x0) / 2 AS hx, (p.y1 - p.y0) / 2 AS hy,
    cos(radians(sample_id % 12 * 15 + 4)) AS c, sin(radians(sample_id % 12 * 15 + 4)) AS s, least(g.z1, p.z1) - greatest(g.z0, p.z0) AS h, {volume_sql('g.')} AS vg, {volume_sql('p.')} AS vp
  FROM gt g JOIN pred p USING (sample_id, label)
), near AS (SELECT * FROM pair WHERE h > 0 AND abs(cx - (x0 + x1) / 2) < (x1 - x0) / 2 + abs(hx * c) + abs(hy * s) AND abs(cy - (y0 + y1) / 2) < (y1 - y0) / 2 + abs(hx * s) + abs(hy * c)
), turned AS (SELECT n.*, k, cx + a * hx * c - b * hy * s AS px, cy + a * hx * s + b * hy * c AS py FROM near n, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) v(k, a, b)
), edge AS (SELECT t.*, u.px AS qx, u.py AS qy FROM turned t JOIN turned u ON u.sample_id = t.sample_id AND u.gt_idx = t.gt_idx AND u.obj_idx = t.obj_idx AND u.k = (t.k + 1) % 4
), point AS (
  SELECT sample_id, gt_idx, obj_idx, px AS x, py AS y FROM turned WHERE px BETWEEN x0 - 1e-12 AND x1 + 1e-12 AND py BETWEEN y0 - 1e-12 AND y1 + 1e-12
  UNION ALL SELECT sample_id, gt_idx, obj_idx, x, y FROM (SELECT *, CASE i WHEN 0 THEN x0 ELSE x1 END AS x, CASE j WHEN 0 THEN y0 ELSE y1 END AS y FROM near, range(0, 2) a(i), range(0, 2) b(j))
    WHERE abs((x - cx) * c + (y - cy) * s) <= hx + 1e-12 AND abs((y - cy) * c - (x - cx) * s) <= hy + 1e-12
  UNION ALL SELECT sample_id, gt_idx, obj_idx, x, py + (x - px) / (qx - px) * (qy - py) FROM (SELECT *, CASE i WHEN 0 THEN x0 ELSE x1 END AS x FROM edge, range(0, 2) a(i)) WHERE (px - x) * (qx - x) < 0 AND py + (x - px) / (qx - px) * (qy - py) BETWEEN y0 AND y1
  UNION ALL SELECT sample_id, gt_idx, obj_idx, px + (y - py) / (qy - py) * (qx - px), y FROM (SELECT *, CASE i WHEN 0 THEN y0 ELSE y1 END AS y FROM edge, range(0, 2) a(i)) WHERE (py - y) * (qy - y) < 0 AND px + (y - py) / (qy - py) * (qx - px) BETWEEN x0 AND x1
), mid AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS angle FROM point WINDOW w AS (PARTITION BY sample_id, gt_idx, obj_idx)
), ring AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM mid WINDOW w AS (PARTITION BY sample_id, gt_idx, obj_idx ORDER BY angle)
), area AS (SELECT sample_id, gt_idx, obj_idx, abs(sum(x * ny - nx * y)) / 2 AS area FROM ring GROUP BY ALL
), shared AS (SELECT n.*, least(coalesce(area, 0) * h, vg, vp) AS joint FROM near n LEFT JOIN area USING (sample_id, gt_idx, obj_idx)
), turned_iou AS (SELECT sample_id, gt_idx, obj_idx, round(joint / (vg + vp - joint), 6) AS iou FROM shared)"""

ORACLE_SQL = {
    "oriented_iou_pairs": f"{_ORIENTED} SELECT * FROM turned_iou WHERE iou > 0",
    "box_volume": f"{_plain} SELECT sample_id, obj_idx, round({volume_sql('')}, 6) AS volume FROM gt",
    "box_iou_pairs": f"{_plain} SELECT * FROM (SELECT sample_id, g.label, g.obj_idx AS gt_idx, p.obj_idx AS pred_idx, round({iou_sql('g.', 'p.')}, 6) AS iou FROM gt g JOIN pred p USING (sample_id, label) WHERE {iou_sql('g.', 'p.')} > 0)",
    "layout_iou": f"{_plain} {_value} {LAYOUT_IOU}",
    "collision_rate": f"{_plain} {_value} {COLLISION}",
    "layout_violation_rate": f"{_plain} {_value} {VIOLATION}",
    "layout_penetration": f"{_plain} {_value} {PENETRATION}",
    "class_protocol_filter": f"{_plain} SELECT sample_id, 'seat' AS label, count(*) AS n FROM pred WHERE label = 'A' GROUP BY 1",
    "score_floor": f"{_plain} SELECT sample_id, obj_idx, label, score FROM pred WHERE score >= 0.5",
    "match_greedy_label": f"{_walk} SELECT sample_id, label, obj_idx, rank, gt_idx FROM walk",
    "match_greedy_agnostic": f"{_any} SELECT sample_id, obj_idx, rank, gt_idx FROM walk",
    "average_precision_scene": f"{_walk} {_value} {AP_SCENE}",
    "ap_per_class": f"{_walk} SELECT label, n_gt, n_detections, round(ap, 6) AS ap FROM {AP_CLASS}",
    "map_dataset": f"{_walk} SELECT count(*) AS n_classes, round(avg(ap), 6) AS value FROM {AP_CLASS}",
    "metric_summary": f"{_walk} SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, value FROM {q}" for n, q in (("layout_iou_3d", LAYOUT_IOU), ("collision_rate", COLLISION), ("layout_violation_rate", VIOLATION), ("layout_penetration", PENETRATION), ("object_map", AP_SCENE)))
    + ") WHERE value IS NOT NULL GROUP BY 1",
}
