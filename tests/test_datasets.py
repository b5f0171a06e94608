"""Policies, splits, audits, mesh files, shape metrics and components that users register."""

import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill import evaluate
from scenemill.config import load
from scenemill.operators import bootstrap, checks, filling, ground_truth, matching, panoramas, planes, scenes
from scenemill.sources import archives, meshes

ROOM = "room_id string, house_id string, split string"
REASON = ROOM + ", reason string, evidence string"


def test_policy_is_applied_once(spark, tmp_path):
    rooms = [(f"h{i // 3}/{i}", f"h{i // 3}", ("train", "val", "test")[i // 3 % 3]) for i in range(18)]
    spark.createDataFrame(rooms, ROOM).write.parquet(f"{tmp_path}/rooms")
    out = [dict(zip(("room_id", "house_id", "split"), r), reason="dark", evidence="log") for r in rooms[:4]]
    policy = {"policy_id": "p", "rooms": out, "expected_original_rooms": 18, "expected_retained_rooms": 14, "views_per_room": 4}
    listed = spark.createDataFrame([(r["room_id"],) for r in out], "room_id string")
    dry = checks.apply_policy(spark, str(tmp_path), policy, listed)
    assert not dry["applied"] and dry["expected_panoramas"] == 56 and not (tmp_path / "policy").exists()
    assert checks.apply_policy(spark, str(tmp_path), policy, listed, apply=True)["applied"]
    again = checks.apply_policy(spark, str(tmp_path), policy, listed, apply=True)
    assert again["already_applied"] and spark.read.parquet(f"{tmp_path}/splits/{again['policy_sha256']}").count() == 14
    with pytest.raises(ValueError, match="another policy"):
        checks.apply_policy(spark, str(tmp_path), policy | {"policy_id": "q"}, listed)
    with pytest.raises(ValueError, match="inventory"):
        checks.apply_policy(spark, str(tmp_path), policy, listed.limit(2))
    other = tmp_path / "other"
    spark.createDataFrame(rooms, ROOM).write.parquet(f"{other}/rooms")
    with pytest.raises(ValueError, match="expects 13 retained"):
        checks.apply_policy(spark, str(other), policy | {"expected_retained_rooms": 13}, listed)
    (other / "coco").mkdir()
    with pytest.raises(ValueError, match="coco was derived"):
        checks.apply_policy(spark, str(other), policy, listed)


def test_exclusions_can_be_added_again(spark):
    missing = spark.createDataFrame([("a/1",), ("a/2",)], "room_id string")
    reasons = spark.createDataFrame([("a/1", "dark"), ("b/9", "unused"), ("a/2", "  ")], "room_id string, reason string")
    plan, unexplained = checks.exclusions_of(missing, reasons, "log")
    assert [tuple(r) for r in plan.collect()] == [("a/1", "a", "excluded", "dark", "log")] and [r[0] for r in unexplained.collect()] == ["a/2"]
    policy = spark.createDataFrame([], REASON)
    once = checks.extended_policy(policy, plan)
    assert checks.extended_policy(once, plan).count() == once.count() == 1
    with pytest.raises(ValueError, match="a/2"):
        checks.refuse(unexplained, "no reason")


def test_greedy_split_is_the_fold_over_shuffled_houses(spark):
    draw = random.Random(4)
    rooms = [(f"{h:03d}/{k}", f"{h:03d}") for h in range(90) for k in range(draw.randint(1, 9))]
    got = {r.house_id: r.split for r in checks.greedy_house_split(spark.createDataFrame(rooms, "room_id string, house_id string"), 0.2, 0.1, seed=5).collect()}
    order = sorted({h for _, h in rooms})
    random.Random(5).shuffle(order)
    sizes, want, held = {h: sum(x == h for _, x in rooms) for h in order}, {}, {"train": 0, "val": 0, "test": 0}
    goal = {"train": len(rooms) * (1.0 - 0.2 - 0.1), "val": len(rooms) * 0.2, "test": len(rooms) * 0.1}
    for h in order:
        want[h] = max(held, key=lambda s: goal[s] - held[s])
        held[want[h]] += sizes[h]
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 65, 1025, 40_000])
def test_shuffled_places_are_those_of_python(spark, n):
    want = list(range(n))
    random.Random(11).shuffle(want)
    # several blocks within a run of equal bits
    assert [r.number for r in filling.shuffled_places(spark, n, 11, draws=3000).orderBy("place").collect()] == want


@pytest.mark.parametrize("weights", ["even", "alike", "hot first", "hot last", "hot twice", "none"])
def test_fill_is_one_sequence(spark, weights):
    draw = random.Random(8)
    much = [2 if weights == "alike" else draw.randint(0, 12) for _ in range(0 if weights == "none" else 3000)]
    for k in {"hot first": [5], "hot last": [2900], "hot twice": [700, 1500]}.get(weights, []):
        much[k] = sum(much) // 2  # more than the goals of val and test
    goals = {s: sum(much) * share for s, share in (("train", 0.7), ("val", 0.15), ("test", 0.15))}
    held, want = dict.fromkeys(goals, 0), {}
    for k, n in enumerate(much):
        want[k] = max(goals, key=lambda s: goals[s] - held[s])
        held[want[k]] += n
    rows = spark.createDataFrame(list(enumerate(much)), "k long, n long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = filling.greedy_fill(rows, "n", [F.col("k")], goals, "split")
        assert {r.k: r.split for r in filled.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_detections_of_one_class(spark):
    n = 200_000
    rows = [("c", i, (i * 7919 % n) / n, 1, 0 if i % 5 < 2 else None) for i in range(n)]
    m = spark.createDataFrame(rows, "label string, sample_id long, score double, rank int, gt_idx int")
    labels = m.where("gt_idx is not null").select("label")
    (row,) = matching.precision_by_class(m, labels).collect()
    order = sorted(range(n), key=lambda i: (-((i * 7919 % n) / n), i))
    tp = np.array([i % 5 < 2 for i in order])
    precision = np.cumsum(tp) / np.arange(1, n + 1)
    best = np.maximum.accumulate(precision[::-1])[::-1]
    assert row.n_detections == n and row.ap == pytest.approx(best[tp].sum() / tp.sum())


def test_bootstrap_replays_a_long_metric():
    draw = random.Random(1)
    values = [draw.random() for _ in range(3000)]
    again = random.Random(7)
    means = sorted(sum(values[again.randrange(3000)] for _ in range(3000)) / 3000 for _ in range(2000))
    assert bootstrap.exact_bounds(values, 7) == pytest.approx((means[50], means[1950]))


def test_relations_of_turned_boxes(spark):
    kind = "sample_id long, obj_idx int, object_id string, box struct<center:array<double>,size:array<double>,basis:array<array<double>>>"
    c = math.sqrt(0.5)
    turned, flat = [[c, c, 0.0], [-c, c, 0.0], [0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [
        (1, 0, "a", ([1.0, 1.0, 0.5], [1.0, 1.0, 1.0], flat)), (1, 1, "b", ([2.2, 1.0, 0.5], [1.0, 1.0, 1.0], turned)),  # the corner of b reaches into a
        (1, 2, "c", ([2.1, 2.1, 0.5], [1.0, 1.0, 1.0], turned)),  # bounds of a and c meet, boxes do not
        (1, 3, "d", ([4.9, 3.0, 1.9], [0.2, 0.2, 0.2], flat)),
    ]
    layout = spark.createDataFrame([(1, [[0.0, 0.0], [5.0, 0.0], [5.0, 6.0], [0.0, 6.0]], 0.0, 2.0)], "sample_id long, ring array<array<double>>, floor_z double, ceiling_z double")
    got = {(r.source, r.target) for r in scenes.relations(spark.createDataFrame(rows, kind), layout).collect()}
    assert {p for p in got if not p[1].startswith("layout")} == {("a", "b"), ("b", "c")}
    assert ("d", "layout::wall_1") in got and ("d", "layout::ceiling") in got and ("d", "layout::floor") not in got and ("a", "layout::floor") in got


def test_boxes_around_points(spark):
    draw = np.random.default_rng(3)
    turn = 0.4
    local = draw.uniform(-1, 1, (300, 3)) * [3, 1, 0.5]
    axis = np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    world = np.column_stack([local[:, :2] @ axis, local[:, 2]]) + [5, -2, 1]
    (r,) = ground_truth.upright_boxes(spark.createDataFrame([("k", *map(float, p)) for p in world], "k string, x double, y double, z double"), "k").collect()
    values, vectors = np.linalg.eigh(np.cov((world - world.mean(axis=0))[:, :2].T))
    main = vectors[:, np.argmax(values)]
    main = main * (1 if main[0] >= 0 else -1)
    assert r.basis[0][:2] == pytest.approx(main.tolist())
    along = world[:, :2] @ main
    assert r.size[0] == pytest.approx(along.max() - along.min()) and r.size[2] == pytest.approx(np.ptp(world[:, 2]))


def test_seam_of_a_ring_is_cut_at_its_widest_gap(spark):
    occupied = [0, 1, 2, 3, 6, 7, 8, 12, 13, 14, 15]
    rows = [(1, r, c) for c in occupied for r in (2, 3)] + [(2, 0, c) for c in (0, 1, 15)] + [(3, 5, c) for c in (4, 5)]
    got = sorted(tuple(r) for r in panoramas.seam_pieces(spark.createDataFrame(rows, "mask int, row int, col int"), "mask", 16).collect())
    assert got == [(1, 0, 0, 0, 2, 9, 2, 14), (1, 0, 1, 12, 2, 4, 2, 8), (2, 1, 0, 7, 0, 3, 1, 3), (3, 0, 0, 4, 5, 2, 1, 2)]
    both = spark.createDataFrame([(1, 0, c) for c in range(16)], "mask int, row int, col int")
    (whole,) = panoramas.seam_pieces(both, "mask", 16).collect()
    assert (whole.frame, whole.w, whole.area) == (0, 16, 16)


def test_densities_equal_brute_force(spark):
    p = np.random.default_rng(5).random((40, 3))
    (r,) = planes.local_densities(spark.createDataFrame([(1, p.tolist())], "k long, cloud array<array<double>>"), "k", neighbours=6).collect()
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    own = np.sort(d, axis=1)[:, 1]
    assert r.densities == pytest.approx([own[np.argsort(row)[:6]].max() for row in d])


def test_mesh_files_round_trip(spark, tmp_path):
    v, f = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], float), np.array([[0, 1, 2], [0, 2, 3]])
    (tmp_path / "a.ply").write_bytes(meshes.ply_bytes(v, f))
    (tmp_path / "b.f32").write_bytes(meshes.f32_bytes(v))
    crlf = "ply\r\nformat ascii 1.0\r\nelement vertex 3\r\nproperty float x\r\nproperty float y\r\nproperty float z\r\nelement face 1\r\nproperty list uchar int vertex_indices\r\nend_header\r\n0 0 0\r\n1 0 0\r\n0 1 0\r\n3 0 1 2\r\n"
    (tmp_path / "c.ply").write_bytes(crlf.encode())
    read = meshes.read_meshes(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r for r in read.collect()}
    assert got["a.ply"].vertices == v.tolist() and got["a.ply"].faces == f.tolist() and got["b.f32"].vertices == v.tolist() and got["c.ply"].faces == [[0, 1, 2]]
    packed = {r.path.rsplit("/", 1)[-1]: r for r in meshes.packed_meshes(read).collect()}
    assert bytes(packed["a.ply"].ply) == meshes.ply_bytes(v, f) and bytes(packed["b.f32"].f32) == meshes.f32_bytes(v)


def test_furniture_of_source_scenes(spark, tmp_path):
    scene = {
        "furniture": [{"uid": "u1", "jid": "j1", "size": [[1, -2, 3]], "sourceCategoryId": "c", "title": "t/x"}, {"uid": "u2", "jid": "j2", "bbox": [1, 1]}, {"uid": "u3", "jid": ""}],
        "scene": {"room": [{"instanceid": "r", "children": [{"ref": "u1", "scale": [2, 1, -1]}, {"ref": "u1"}, {"ref": "u2"}, {"ref": "zz"}]}]},
    }
    (tmp_path / "house.json").write_text(json.dumps(scene))
    items, placed = meshes.furniture(spark, str(tmp_path))
    assert [(r.house, r.jid, r["size"], r.title) for r in items.collect()] == [("house", "j1", [1.0, 2.0, 3.0], "t/x")]
    assert [(r.room, r.pos, r["size"]) for r in placed.orderBy("pos").collect()] == [("r", 0, [2.0, 2.0, 3.0]), ("r", 1, [1.0, 2.0, 3.0])]
    with zipfile.ZipFile(tmp_path / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("scenes/note.txt", "none")
        for name in ("house", "other", "third"):
            z.writestr(f"scenes/{name}.json", json.dumps(scene))
    packed = [df.where("house = 'house'") for df in meshes.furniture(spark, f"{tmp_path}/all.zip")]
    assert [sorted(map(tuple, df.collect()), key=str) for df in packed] == [sorted(map(tuple, df.collect()), key=str) for df in (items, placed)]
    for size in (1, 1 << 20):
        rows = archives.read_members(spark, f"{tmp_path}/all.zip", "*.json", size)
        assert rows.rdd.getNumPartitions() == (3 if size == 1 else 1)
        assert {(r.name, r["size"]) for r in rows.collect()} == {(f"scenes/{n}.json", len(json.dumps(scene))) for n in ("house", "other", "third")}
    assert archives.read_members(spark, f"{tmp_path}/all.zip", "*.bin").count() == 0


def test_rooms_of_a_folder(spark, tmp_path):
    for name in ("h/r1/a.glb", "h/r2/b.glb", "h/r2/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(tuple(r) for r in meshes.room_files(spark, str(tmp_path)).collect()) == [("h/r1", "a.glb"), ("h/r2", "b.glb")]
    with pytest.raises(ValueError, match="h/r3"):
        meshes.room_files(spark, str(tmp_path), spark.createDataFrame([("h/r1",), ("h/r3",)], "room_id string"))


def shape_run(tmp_path):
    cube = [[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    box = lambda x: {"min_corner": [x, 0, 0], "max_corner": [x + 1, 1, 1]}
    (tmp_path / "pred").mkdir()
    (tmp_path / "shapes").mkdir()
    (tmp_path / "img.txt").write_text("x")
    (tmp_path / "shapes" / "far.json").write_text(json.dumps({"points": [[p[0] + 0.5, p[1], p[2]] for p in cube]}))
    truth = {"objects": [{"object_id": "1", "label": "a", "bbox": box(0), "attributes": {"shape": json.dumps(cube)}}, {"object_id": "2", "label": "b", "bbox": box(5), "attributes": {"shape": json.dumps({"points": cube})}}, {"object_id": "3", "label": "c", "bbox": box(9)}]}
    pred = {"objects": [{"object_id": "1", "label": "z", "bbox": box(0), "attributes": {"shape": "far.json"}}, {"object_id": "2", "label": "b", "bbox": box(5), "attributes": {"shape": json.dumps(cube)}}, {"object_id": "3", "label": "c", "bbox": box(9), "attributes": {"shape": "far.json"}}]}
    (tmp_path / "pred" / "s.json").write_text(json.dumps(pred))
    (tmp_path / "pred" / "t.json").write_text(json.dumps({"objects": []}))
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"sample_id": n, "input": "img.txt", "ground_truth": truth}) + "\n" for n in "st"))
    (tmp_path / "run.json").write_text(json.dumps({
        "experiment_name": "shapes", "output_dir": "out", "dataset": {"type": "manifest", "parameters": {"manifest": "m.jsonl"}}, "model": {"type": "fixture", "parameters": {"prediction_dir": "pred"}},
        "metrics": [{"type": t, "parameters": {"mesh_root": "shapes", "normalize": "none", "num_points": 16}} for t in ("mesh_chamfer", "mesh_fscore")],
    }))
    return load(tmp_path / "run.json")


def test_shape_metrics_of_matched_pairs(spark, tmp_path):
    got = evaluate.run(spark, shape_run(tmp_path))
    # the moved cube is half an edge off both ways, the same one is not, and the third pair has no true shape
    assert got["mesh_chamfer"]["count"] == 1 and got["mesh_chamfer"]["mean"] == pytest.approx((0.5 + 0.0) / 2)
    assert got["mesh_fscore"]["mean"] == pytest.approx((0.0 + 1.0) / 2)


def test_users_register_metrics_and_models(spark, tmp_path):
    experiment = shape_run(tmp_path)
    try:
        evaluate.per_scene("objects_per_scene")(lambda t, p: t["scenes"].join(t["preds"].groupBy("sample_id").agg(F.count("*").cast("double").alias("value")), "sample_id", "left").select("sample_id", F.coalesce("value", F.lit(0.0)).alias("value")))
        evaluate.per_dataset("objects_in_all")(lambda t, p: t["preds"].agg(F.count("*").cast("double").alias("value")))
        evaluate.MODELS.register("nothing")(lambda spark, parameters, manifest: manifest.select("sample_id", F.lit('{"objects": []}').alias("prediction")))
        metrics = [{"type": "Objects_per_scene", "parameters": {}}, {"type": "objects_in_all", "parameters": {}}]
        made = type(experiment)(experiment.name, 0, experiment.output_dir, experiment.dataset, experiment.model, metrics)
        got = evaluate.run(spark, made)
        assert got["Objects_per_scene"]["mean"] == 1.5 and got["objects_in_all"]["value"] == 3.0
        made = type(experiment)(experiment.name, 0, experiment.output_dir, experiment.dataset, {"type": "nothing", "parameters": {}}, metrics)
        assert evaluate.run(spark, made)["objects_in_all"]["value"] == 0.0
        with pytest.raises(ValueError, match="unknown dataset"):
            evaluate.tables(spark, type(experiment)("x", 0, "o", {"type": "none", "parameters": {}}, experiment.model, metrics))
    finally:
        for registry, name in ((evaluate.METRICS, "objects_per_scene"), (evaluate.METRICS, "objects_in_all"), (evaluate.MODELS, "nothing")):
            registry.made.pop(name, None)


def test_ground_truth_is_written_by_split(spark, tmp_path):
    rows = [("a/1", "train", "i.png", 1), ("b/1", "val", "j.png", 2)]
    ground_truth.write_ground_truth(spark.createDataFrame(rows, "sample_id string, split string, input string, objects int"), str(tmp_path / "gt"))
    back = {r.sample_id: r for r in spark.read.json(f"{tmp_path}/gt/scenes").collect()}
    assert back["b/1"].split == "val" and spark.read.json(f"{tmp_path}/gt/manifests").where("split = 'train'").first().ground_truth == "scenes/split=train"
    parts = spark.createDataFrame([(0, 1), (2, 1)], "part int, n int")
    with pytest.raises(ValueError, match=r"parts \[1\] are missing"):
        ground_truth.merged_parts(parts, 3)
