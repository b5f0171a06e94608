"""Scoring operators on cases with known values, and on the ties and gaps where rewrites drift."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill import evaluate
from scenemill.config import Registry, expanded, load
from scenemill.functions import boxes, polygons
from scenemill.operators import bootstrap, matching, scene_metrics as M, shapes

BOX = "struct<x0:double,y0:double,z0:double,x1:double,y1:double,z1:double>"
NAN = float("nan")


def objects(spark, rows):
    """(sample_id, obj_idx, label, score, box)"""
    return spark.createDataFrame(rows, f"sample_id string, obj_idx int, label string, score double, box {BOX}")


def scenes(spark, rows):
    return spark.createDataFrame(rows, f"sample_id string, gt_layout {BOX}, pred_layout {BOX}")


def cube(x=0.0, y=0.0, z=0.0, s=1.0):
    return (x, y, z, x + s, y + s, z + s)


def values(df):
    return {r["sample_id"]: r["value"] for r in df.collect()}


def test_layout_iou(spark):
    room = (0.0, 0.0, 0.0, 2.0, 2.0, 2.0)
    got = values(M.layout_iou(scenes(spark, [("a", room, (1.0, 1.0, 1.0, 3.0, 3.0, 3.0)), ("b", None, room), ("c", room, None), ("d", (NAN, 0.0, 0.0, 2.0, 2.0, 2.0), room), ("e", room, (0.0, 0.0, 0.0, 0.0, 2.0, 2.0))])))
    assert got["a"] == pytest.approx(1 / 15) and got["b"] is None and got["c"] == 0.0 and got["d"] == 0.0 and got["e"] == 0.0


def test_nan_never_wins(spark):
    numbers = [NAN, 0.0, 1.0, 2.5]
    rows = [(a, b) for a in numbers for b in numbers]
    df = spark.createDataFrame(rows, "a double, b double")
    got = df.select("a", "b", boxes.first_min(F.col("a"), F.col("b")).alias("lo"), boxes.first_max(F.col("a"), F.col("b")).alias("hi"), boxes.length(F.col("a")).alias("len")).collect()
    for r in got:
        assert str(r.lo) == str(min(r.a, r.b)) and str(r.hi) == str(max(r.a, r.b)) and r.len == max(0.0, r.a)


def test_collisions_and_empty_scenes(spark):
    o = objects(spark, [("a", 0, "x", 1.0, cube()), ("a", 1, "x", 1.0, cube(0.5)), ("a", 2, "y", 1.0, cube(9.0)), ("b", 0, "x", 1.0, cube())])
    s = scenes(spark, [("a", None, None), ("b", None, None), ("empty", None, None)])
    assert values(M.collision_rate(s, o)) == {"a": pytest.approx(1 / 3), "b": 0.0, "empty": 0.0}
    assert values(M.collision_rate(s, o, minimum=0.5))["a"] == 0.0


def test_violation_and_penetration(spark):
    room = (0.0, 0.0, 0.0, 10.0, 10.0, 3.0)
    o = objects(spark, [("a", 0, "x", 1.0, (1.0, 1.0, 2.25, 2.0, 2.0, 3.25)), ("a", 1, "x", 1.0, cube(4.0)), ("a", 2, "x", 1.0, (5.0, 5.0, 1.0, 5.0, 6.0, 2.0)), ("c", 0, "x", 1.0, cube())])
    s = scenes(spark, [("a", None, room), ("b", None, room), ("c", None, None)])
    assert values(M.layout_penetration(s, o)) == {"a": pytest.approx(0.125), "b": 0.0, "c": None}
    assert values(M.layout_violation_rate(s, o))["a"] == 0.5 and values(M.layout_violation_rate(s, o, 0.3))["a"] == 0.0
    assert values(M.layout_violation_rate(s, o, 0.25))["a"] == 0.0  # just the tolerance
    with pytest.raises(ValueError):
        M.layout_violation_rate(s, o, 1.0)


def brute_match(preds, labels, threshold):
    def volume(b):
        return math.prod(max(0.0, b[k + 3] - b[k]) for k in range(3))

    def iou(a, b):
        shared = math.prod(max(0.0, min(a[k + 3], b[k + 3]) - max(a[k], b[k])) for k in range(3))
        union = volume(a) + volume(b) - shared
        return shared / union if union > 0 else 0.0

    free, out = dict(labels), []
    for i, score, b in sorted(preds, key=lambda p: (-p[1], p[0])):
        best = max(((iou(b, g), k) for k, g in free.items()), default=(0.0, None))
        hit = best[1] if best[1] is not None and best[0] >= threshold else None
        if hit is not None:
            del free[hit]
        out.append((i, hit))
    return out


def test_greedy_match_with_ties(spark):
    draw = random.Random(0)
    preds, labels, want = [], [], {}
    for s in range(30):
        spot = lambda: cube(draw.choice([0.0, 0.25, 0.5]), draw.choice([0.0, 0.5]))
        p = [(i, draw.choice([0.5, 0.9]), spot()) for i in range(draw.randint(0, 5))]
        g = [(i, spot()) for i in range(draw.randint(0, 4))]
        preds += [(str(s), i, "x", score, b) for i, score, b in p]
        labels += [(str(s), i, "x", 1.0, b) for i, b in g]
        want[str(s)] = brute_match(p, g, 0.3)
    got = {}
    for r in matching.greedy_match(objects(spark, preds), objects(spark, labels), ["sample_id"], 0.3).orderBy("sample_id", "rank").collect():
        got.setdefault(r.sample_id, []).append((r.obj_idx, r.gt_idx))
    assert got == {k: v for k, v in want.items() if v}


def test_equal_overlap_takes_the_higher_label(spark):
    labels = objects(spark, [("a", 0, "x", 1.0, cube()), ("a", 1, "x", 1.0, cube())])
    got = matching.greedy_match(objects(spark, [("a", 0, "x", 0.5, cube()), ("a", 1, "x", 0.5, cube())]), labels, ["sample_id"], 0.5).collect()
    assert {(r.obj_idx, r.gt_idx) for r in got} == {(0, 1), (1, 0)}


def test_average_precision(spark):
    """A false positive in front of a hit, and a label never found."""
    labels = objects(spark, [("a", 0, "x", 1.0, cube())])
    preds = objects(spark, [("a", 0, "x", 0.9, cube(5.0)), ("a", 1, "x", 0.8, cube()), ("a", 2, "absent", 0.99, cube(7.0))])
    s = scenes(spark, [("a", None, None), ("none", None, None)])
    assert values(M.object_map(s, preds, labels)) == {"a": pytest.approx(0.5), "none": 0.0}
    assert values(M.object_map(s, preds, labels, empty=None))["none"] is None
    # a class that this scene lacks costs nothing here, but is a false positive for the whole set
    more = objects(spark, [("a", 0, "x", 1.0, cube()), ("b", 0, "absent", 1.0, cube())])
    pooled = {r.label: r.ap for r in M.dataset_map(preds.unionByName(objects(spark, [("b", 0, "absent", 0.5, cube())])), more).collect()}
    assert pooled == {"x": pytest.approx(0.5), "absent": pytest.approx(0.5)}
    with pytest.raises(ValueError):
        M.object_map(s, preds, labels, 0.0)


def test_pooled_precision_equals_plain_python(spark):
    draw = random.Random(4)
    rows = [(f"c{draw.randint(0, 2)}", f"s{draw.randint(0, 30):02}", draw.choice([0.1, 0.5, 0.7]), i, draw.choice([None, 0])) for i in range(400)]
    m = spark.createDataFrame(rows, "label string, sample_id string, score double, rank int, gt_idx int")
    labels = spark.createDataFrame([(f"c{k}",) for k in range(4) for _ in range(90)], "label string")
    got = {r.label: r.ap for r in matching.precision_by_class(m, labels).collect()}
    for c in ("c0", "c1", "c2", "c3"):
        hits = [r[4] is not None for r in sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], x[1], x[3]))]
        precision = [sum(hits[: i + 1]) / (i + 1) for i in range(len(hits))]
        want = sum(max(precision[i:]) for i, h in enumerate(hits) if h) / 90
        assert got[c] == pytest.approx(want)


def test_class_protocol(spark):
    o = objects(spark, [("a", 0, "chair", 1.0, cube()), ("a", 1, "plant", 1.0, cube()), ("a", 2, "stool", 1.0, cube())])
    labels = lambda df: sorted(r.label for r in df.collect())
    assert labels(matching.class_protocol(o, {"chair": "seat", "stool": "seat"})) == ["seat", "seat"]
    assert labels(matching.class_protocol(o, None, ["plant"])) == ["plant"] and labels(matching.class_protocol(o, {}, None)) == []


def turned(x, y, angle, sx=1.0, sy=1.0, sz=1.0, tilt=None):
    c, s = math.cos(angle), math.sin(angle)
    return ([float(x), float(y), 0.0], [sx, sy, sz], tilt or [[c, s, 0.0], [-s, c, 0.0], [0.0, 0.0, 1.0]])


def oriented(spark, pairs):
    kind = "struct<center:array<double>,size:array<double>,basis:array<array<double>>>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {kind}, b {kind}")
    df = df.withColumns({n: boxes.sanitized(F.col(n)) for n in "ab"})
    return [r.iou for r in polygons.oriented_iou(df, "a", "b").orderBy("i").collect()]


def test_oriented_iou(spark):
    flat = turned(0, 0, 0)
    got = oriented(spark, [(flat, turned(0, 0, math.pi / 4)), (flat, turned(0.5, 0, 0)), (flat, turned(5, 0, 0)), (flat, turned(0, 0, 0, sx=NAN)), (flat, turned(0, 0, 0, sx=-1.0)), (flat, turned(0, 0, math.pi / 2))])
    assert got == pytest.approx([1 / math.sqrt(2), 1 / 3, 0.0, 0.0, 0.0, 1.0])
    lean = [[1.0, 0.0, 0.0], [0.0, math.sqrt(0.5), math.sqrt(0.5)], [0.0, -math.sqrt(0.5), math.sqrt(0.5)]]
    assert oriented(spark, [(turned(0, 0, 0, tilt=lean), turned(0, 0, 0, tilt=lean))])[0] == pytest.approx(1.0)  # held to the volume


def test_clip_against_sampling():
    draw = np.random.default_rng(1)
    for _ in range(20):
        a, b = [draw.uniform(-1, 1, (6, 2)) for _ in range(2)]
        p = draw.uniform(-1, 1, (40_000, 2))
        inside = lambda h: np.all([((h[(i + 1) % len(h)][0] - h[i][0]) * (p[:, 1] - h[i][1]) - (h[(i + 1) % len(h)][1] - h[i][1]) * (p[:, 0] - h[i][0])) >= 0 for i in range(len(h))], axis=0)
        assert polygons.shared_area(a, b) == pytest.approx(4 * (inside(polygons.hull(a)) & inside(polygons.hull(b))).mean(), abs=0.05)
    assert polygons.shared_area([(0, 0), (1, 1)], [(0, 0), (1, 0), (0, 1)]) == 0.0


def test_corners_and_bounds(spark):
    (r,) = spark.range(1).select(boxes.bounds(boxes.corners(boxes.as_oriented(boxes.box(*[F.lit(v) for v in (0.0, 1.0, 2.0, 3.0, 5.0, 9.0)])))).alias("b"), boxes.valid(boxes.box(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 1.0)])).alias("v")).collect()
    assert tuple(r.b) == (0.0, 1.0, 2.0, 3.0, 5.0, 9.0) and not r.v


@pytest.mark.parametrize("n", [1, 2, 60])
def test_bootstrap_replays(spark, n):
    draw = random.Random(9)
    held = [draw.random() for _ in range(n)]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(held)] + [("m", 999, None), ("flat", 0, 2.0), ("flat", 1, 2.0)], "metric string, ordinal long, value double").repartition(3)
    got = {r.metric: r for r in bootstrap.intervals(df, 5).collect()}
    again = random.Random(5)
    means = sorted(sum(held[again.randrange(n)] for _ in range(n)) / n for _ in range(2000)) if n > 1 else held * 2000
    assert (got["m"].ci_low, got["m"].ci_high) == pytest.approx((means[50], means[1950])) and got["m"].n == n
    assert got["flat"].ci_low == got["flat"].ci_high == 2.0


def test_bootstrap_laws_agree(spark):
    held = np.random.default_rng(0).normal(3, 1, 1500)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(held)], "metric string, ordinal long, value double")
    exact, wide = bootstrap.intervals(df).first(), bootstrap.intervals(df, law="poisson").first()
    assert abs(exact.ci_low - wide.ci_low) < 0.02 and abs(exact.ci_high - wide.ci_high) < 0.02 and exact.n == wide.n == 1500
    with pytest.raises(ValueError, match="law"):
        bootstrap.intervals(df, law="guess")


def test_bootstrap_in_chunks_is_one_sequence(spark, monkeypatch):
    held = np.random.default_rng(1).normal(0, 1, 700)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(held)], "metric string, ordinal long, value double")
    want = bootstrap.exact_bounds(held.tolist(), 3)
    for chunk in (1 << 27, 150_000, 30_000):
        monkeypatch.setattr(bootstrap, "CHUNK", chunk)
        cuts = list(bootstrap.cut_points(700, 3, min(2000, -(-2000 * 700 // chunk))))
        assert sum(c[1] for c in cuts) == 2000 and [c[0] for c in cuts] == list(np.cumsum([0] + [c[1] for c in cuts[:-1]]))
        got = bootstrap.intervals(df, 3).first()
        assert (got.ci_low, got.ci_high) == pytest.approx(want)


def test_shapes_equal_numpy(spark):
    draw = np.random.default_rng(2)
    clouds = [(i, draw.random((12, 3)).tolist(), draw.random((9, 3)).tolist()) for i in range(8)]
    df = spark.createDataFrame(clouds, "i long, pred array<array<double>>, truth array<array<double>>")
    near = df.select("i", shapes.nearest(F.col("pred"), F.col("truth")).alias("f"), shapes.nearest(F.col("truth"), F.col("pred")).alias("b"))
    got = {r.i: (r.c, r.s) for r in near.select("i", shapes.chamfer(F.col("f"), F.col("b")).alias("c"), shapes.fscore(F.col("f"), F.col("b"), 0.3).alias("s")).collect()}
    big = {r.i: (r.chamfer, r.fscore) for r in shapes.cloud_scores(df, "i", threshold=0.3).collect()}
    for i, p, q in clouds:
        d = ((np.array(p)[:, None] - np.array(q)[None]) ** 2).sum(axis=2)
        a, b = (d.min(1) <= 0.09).mean(), (d.min(0) <= 0.09).mean()
        assert got[i] == pytest.approx((d.min(1).mean() + d.min(0).mean(), 2 * a * b / (a + b) if a + b else 0.0)) and big[i] == pytest.approx(got[i])
    same = shapes.normalized(spark.createDataFrame([(0, [[0.0, 0.0, 0.0]], [[5.0, 5.0, 5.0]])], df.schema), "pred", "truth", "canonical").first()
    assert same.pred == same.truth == [[0.0, 0.0, 0.0]]


def toy(tmp_path, boxes_of="aligned"):
    scene = {"layout": {"min_corner": [0, 0, 0], "max_corner": [4, 3, 5]}, "objects": [{"object_id": "c", "label": "chair", "score": 0.9, "bbox": {"min_corner": [0, 0, 0], "max_corner": [1, 1, 1]}}, {"object_id": "t", "label": "table", "bbox": {"min_corner": [2, 0, 0], "max_corner": [3, 1, 1]}}], "relations": [{"source_id": "c", "target_id": "t", "relation_type": "near"}]}
    (tmp_path / "pred").mkdir()
    (tmp_path / "img.txt").write_text("x")
    (tmp_path / "gt.json").write_text(json.dumps(scene))
    for n in ("a", "b"):
        (tmp_path / "pred" / f"{n}.json").write_text(json.dumps(scene))
    (tmp_path / "manifest.jsonl").write_text(json.dumps({"sample_id": "a", "input": "img.txt", "ground_truth": "gt.json"}) + "\n\n" + json.dumps({"sample_id": "b", "input": "img.txt", "ground_truth": scene}) + "\n")
    (tmp_path / "base.json").write_text(json.dumps({"dataset": {"type": "manifest", "parameters": {"manifest": "manifest.jsonl"}}, "model": {"type": "fixture", "parameters": {"predictions": "pred"}}, "seed": 3}))
    (tmp_path / "run.yaml").write_text("extends: base.json\nexperiment_name: toy\noutput_dir: out\nmetrics:\n- layout_iou_3d\n- collision_rate\n- type: object_map\n- type: object_map_dataset\n  parameters: {per_class: ap, classes: [chair, table]}\n")
    return load(tmp_path / "run.yaml")


def test_experiment_end_to_end(spark, tmp_path):
    got = evaluate.run(spark, toy(tmp_path))
    assert got["layout_iou_3d"]["mean"] == 1.0 and got["collision_rate"]["mean"] == 0.0 and got["object_map"] == {"count": 2, "mean": 1.0, "median": 1.0, "ci95_low": 1.0, "ci95_high": 1.0}
    assert got["ap_chair"]["value"] == got["ap_table"]["value"] == 1.0
    assert "| layout_iou_3d | 2 | 1.000000 | 1.000000 | [1.000000, 1.000000] |" in (tmp_path / "out" / "report.md").read_text()
    assert json.loads((tmp_path / "out" / "run.json").read_text())["revision"] == evaluate.revision()
    evaluate._put(spark, str(tmp_path / "out" / "report.md"), "anew")
    assert (tmp_path / "out" / "report.md").read_text() == "anew" and not (tmp_path / "out" / "report.md.part").exists()
    assert [json.loads(x)["sample_id"] for p in sorted((tmp_path / "out" / "metrics.jsonl").glob("part-*")) for x in p.read_text().splitlines()] == ["a", "b"]


def test_experiment_on_oriented_boxes(spark, tmp_path):
    experiment = toy(tmp_path)
    c = math.sqrt(0.5)
    turn = lambda x, y, z, sx, sy, sz: {"center": [x, y, z], "size": [sx, sy, sz], "basis": [[c, c, 0], [-c, c, 0], [0, 0, 1]]}
    flat = {"min_corner": [-0.5, -0.5, 0], "max_corner": [0.5, 0.5, 1]}
    bowl = turn(0, 0, 0.5, 1, 1, 1)  # shares an octagon with the flat one
    objects_of = lambda *boxed: [{"object_id": str(i), "label": n, "bbox": b} for i, (n, b) in enumerate(boxed)]
    room = turn(0, 0, 2, 20, 20, 4)
    pred = {"layout": room, "objects": objects_of(("chair", bowl), ("table", turn(3, 0, 0.5, 1, 1, 1)), ("chair", turn(0.1, 0, 0.5, 1, 1, 1)), ("table", turn(50, 0, 0.5, 1, 1, 1)))}
    truth = {"layout": room, "objects": objects_of(("chair", flat), ("table", turn(3, 0, 0.5, 1, 1, 1)))}
    for n in ("a", "b"):
        (tmp_path / "pred" / f"{n}.json").write_text(json.dumps(pred))
    (tmp_path / "gt.json").write_text(json.dumps(truth))
    (tmp_path / "manifest.jsonl").write_text("".join(json.dumps({"sample_id": n, "input": "img.txt", "ground_truth": "gt.json"}) + "\n" for n in ("a", "b")))
    t = evaluate.tables(spark, experiment)
    value = lambda kind, **parameters: evaluate.metric(kind, parameters, t).first()["value"]
    assert value("layout_iou_3d") == pytest.approx(1.0)
    assert value("collision_rate") == pytest.approx(1 / 6)
    assert value("layout_violation_rate") == value("layout_penetration") == pytest.approx(0.25)
    shared = 2 * (math.sqrt(2) - 1)
    assert value("object_map", iou_threshold=shared / (2 - shared) - 1e-6) == pytest.approx(1.0)
    assert value("object_map", iou_threshold=shared / (2 - shared) + 1e-6) == pytest.approx(0.5)
    assert value("object_map_dataset") == pytest.approx((1 + 2 / 3) / 2)  # of equal scores: hit and miss of a, then of b


def test_config_and_registry(tmp_path):
    (tmp_path / "a.json").write_text('{"extends": "b.json"}')
    (tmp_path / "b.json").write_text('{"extends": "a.json"}')
    with pytest.raises(ValueError, match="extends itself"):
        load(tmp_path / "a.json")
    with pytest.raises(ValueError, match="not unique"):
        expanded(["collision_rate", "collision_rate"], tmp_path)
    with pytest.raises(ValueError, match="needs classes"):
        expanded([{"type": "object_map", "parameters": {"per_class": True}}], tmp_path)
    r = Registry("thing")
    r.register(" Name ")(1)
    r.alias("other", "NAME")
    assert r.get("name") == r.get("OTHER") == 1
    with pytest.raises(ValueError, match="there are name, other"):
        r.get("none")
