"""Curation, scene operators and readers on small cases."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.operators import curation as C, scenes as S
from scenemill.sources import meshes, scenes as R

ROOM = "room_id string, house_id long, split string, views int"


def keys(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_room_rules(spark):
    rooms = spark.createDataFrame([("1/a", 1, "train", 4), ("1/b", 1, "val", 4), ("2/a", 2, "test", 4), ("2/a", 2, "test", 4), ("3/a", 3, "odd", 4)], ROOM)
    assert keys(C.room_faults(rooms), "key", "fault") == [("1", "house in several splits"), ("2/a", "duplicate room"), ("3/a", "unknown split")]
    policy = spark.createDataFrame([("1/a", 1, "train", "bad mesh"), ("9/z", 9, "val", "x"), ("1/b", 2, "val", "x"), ("2/a", 2, "val", "x"), ("3/a", 3, "odd", " ")], "room_id string, house_id long, split string, reason string")
    assert keys(C.policy_faults(rooms.distinct(), policy), "room_id", "fault") == [("1/b", "another house"), ("2/a", "another split"), ("3/a", "no reason"), ("9/z", "unknown room")]
    assert keys(C.exclude(rooms, policy.where("room_id = '1/a'")), "room_id")[0] == ("1/b",)
    renders = spark.createDataFrame([("1/a", f, 10) for f in range(4)] + [("1/b", f, 10 * (f != 2)) for f in range(4)], "room_id string, frame int, bytes int")
    assert ("1/a",) not in keys(C.unrendered(rooms, renders), "room_id") and ("1/b",) in keys(C.unrendered(rooms, renders), "room_id")


def test_house_disjoint_split(spark):
    rooms = spark.createDataFrame([(f"{h}/{r}", h) for h in range(200) for r in range(1 + h % 4)], "room_id string, house_id long").repartition(5)
    got = C.house_disjoint_split(rooms, seed=1).collect()
    by_house = {}
    for r in got:
        by_house.setdefault(r.house_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by_house.values()) and len(got) == rooms.count()
    share = {s: sum(r.split == s for r in got) / len(got) for s in C.SPLITS}
    assert abs(share["val"] - 0.15) < 0.02 and abs(share["test"] - 0.15) < 0.02
    assert sorted(map(str, got)) == sorted(map(str, C.house_disjoint_split(rooms.repartition(2), seed=1).collect()))


def test_scales(spark):
    rooms = spark.createDataFrame([("a", 1.3), ("b", 2.0)], "room_id string, height double")
    known = spark.createDataFrame([("b", 1.7)], "room_id string, scale double")
    assert keys(C.resolved_scale(rooms, known), "room_id", "scale", "scale_source") == [("a", 2.0, "ceiling"), ("b", 1.7, "table")]
    with pytest.raises(Exception, match="must be positive"):
        C.resolved_scale(rooms, known.withColumn("scale", F.lit(0.0))).collect()
    reject, review = C.plausibility(F.col("r"), F.col("a"), F.col("e"))
    got = spark.createDataFrame([(0.4, 300.0, 5.0), (1.6, 20.0, 5.0)], "r double, a double, e double").select(reject.alias("no"), review.alias("look")).collect()
    assert [tuple(r) for r in got] == [(["contour ratio", "area"], []), ([], ["contour ratio"])]
    objects = spark.createDataFrame([("x", [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ("x", [3.0, 1.0, 1.0], [2.0, 6.0, 2.0]), ("y", [1.0, 1.0, 1.0], [1.0, 2.0, 9.0])], "room string, model array<double>, real array<double>")
    assert keys(C.room_scale(objects), "room", "n", "scale", "accepted") == [("x", 2, 2.0, True), ("y", 1, 2.0, False)]


def test_classes(spark):
    titles = spark.createDataFrame([("c", "b", 5), ("c", "a", 1), ("c", "b", 2), ("c", "a", 9), ("d", "z", 0)], "category string, title string, ordinal long")
    assert keys(C.majority_title(titles), "category", "title", "n") == [("c", "a", 2), ("d", "z", 1)]
    items = spark.createDataFrame([("bed/x",)] * 3 + [("bed/y",)] * 2 + [("lamp/x",)], "category string")
    assert keys(C.tail_to_other(items, 5), "class", "n") == [("bed", 5), ("other", 1)]
    sizes = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0)], "class string, size double")
    assert keys(C.mean_sizes(sizes, spark.createDataFrame([("a",), ("b",), ("c",)], "class string")), "class", "size") == [("a", 2.0), ("b", 4.0), ("c", 3.0)]
    assert keys(C.spread_sample(spark.range(9).withColumn("g", F.lit(1)), "g", F.col("id")), "id") == [(0,), (4,), (8,)]


def test_relations_and_walls(spark):
    kind = "struct<x0:double,y0:double,z0:double,x1:double,y1:double,z1:double>"
    o = spark.createDataFrame([("a", 0, (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)), ("a", 1, (1.05, 0.0, 0.0, 2.0, 1.0, 1.0)), ("a", 2, (5.0, 0.0, 0.0, 6.0, 1.0, 1.0)), ("a", 3, (0.0, 0.0, 1.2, 1.0, 1.0, 2.0))], f"sample_id string, obj_idx int, box {kind}")
    assert keys(S.touching(o, 0.1), "source", "target") == [(0, 1)] and keys(S.touching(o, 0.25), "source", "target") == [(0, 1), (0, 3), (1, 3)]
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 4.0], [0.0, 4.0], [0.0, 4.0]]
    room = spark.createDataFrame([("r", ring, 0.0, 2.8, 1.0, 1.0)], "room string, ring array<array<double>>, floor_z double, ceiling_z double, cx double, cy double")
    w = S.walls(room.drop("cx", "cy")).collect()
    assert len(w) == 6 and sum(r.length for r in w) == 16.0 and {r.cz for r in w} == {1.4}
    rays = {r.col: r.distance for r in S.ray_ranges(room, "room", 4).collect()}
    assert rays[1] == pytest.approx(np.sqrt(2)) and rays[2] == pytest.approx(np.sqrt(2))


def test_masks_and_boxes(spark):
    pixels = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 0, 1, 1, 1, 0])] + [("b", i, v) for i, v in enumerate([1, 0])] + [("c", 0, 0)], "mask string, pos int, on int")
    got = {r.mask: r.counts for r in S.mask_runs(pixels, "mask").collect()}
    assert got == {"a": [2, 3, 1], "b": [0, 1, 1], "c": [1]}
    rows = [([0, 0, 3, 2], 3, [2, 3, 1]), ([0, 0, 4, 2], 2, [2, 3, 2]), ([0, 0, 1, 2], 3, [2, 3, 1]), ([0, 0, 3, 2], 3, [2, 3, 2, -1]), ([0, 0, 3, 2], 0, []), (None, None, None)]
    df = spark.createDataFrame(rows, "bbox array<int>, area long, counts array<long>")
    faults = [r[0] for r in df.select(S.annotation_faults(F.lit(3), F.lit(2), F.col("bbox"), F.col("area"), F.col("counts"))).collect()]
    assert faults == [[], ["box", "runs", "area"], ["area"], ["runs", "area"], ["runs", "area"], ["box", "runs", "area"]]
    crop = spark.range(1).select(S.padded_box(F.array(*[F.lit(float(v)) for v in (1, 2, 5, 5)]), F.lit(8), F.lit(20), 0.1).alias("c")).first().c
    assert crop == [0, 2, 6, 8]  # 0.5 and 1.5, 6.5 and 7.5 go to the even number


def test_renumber_and_cameras(spark):
    images = spark.createDataFrame([(p, i) for p in range(3) for i in range(50)], "part int, image_id int").repartition(4)
    notes = images.select("part", "image_id", F.explode(F.array(F.lit(7), F.lit(9))).alias("ann_id"))
    new_images, new_notes = S.renumber(images, notes, [F.col("part"), F.col("image_id")], [F.col("new_image_id"), F.col("ann_id")])
    assert keys(new_images, "new_image_id", "part", "image_id") == [(p * 50 + i + 1, p, i) for p in range(3) for i in range(50)]
    assert keys(new_notes, "new_ann_id") == [(k + 1,) for k in range(300)]
    spots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(c).alias("clearance")) for x, y, c in ((0.0, 0.0, 1.0), (1.0, 0.0, 2.0), (9.0, 0.0, 0.5), (0.0, 5.0, 0.5))])
    got = spark.range(1).select(S.chosen_cameras(spots, 3).alias("c")).first().c
    assert [(p.x, p.y) for p in got] == [(1.0, 0.0), (9.0, 0.0), (0.0, 5.0)]
    assert S.camera_grid(spark.createDataFrame([("r", 0.0, 0.0, 3.0, 3.0)], "room string, x0 double, y0 double, x1 double, y1 double")).count() == 961


def ply(binary):
    head = f"ply\nformat {'binary_little_endian' if binary else 'ascii'} 1.0\nelement other 1\nproperty int k\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n".encode()
    v = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    if binary:
        return head + struct.pack("<i", 5) + b"".join(struct.pack("<3f", *p) for p in v) + struct.pack("<B4i", 4, 0, 1, 2, 3)
    return head + b"5\n" + "\n".join(" ".join(map(str, p)) for p in v).encode() + b"\n4 0 1 2 3\n"


def glb():
    binary = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4").tobytes() + np.array([0, 1, 2], "<u2").tobytes() + b"\0\0"
    doc = {"scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": [0, 0, 2]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "buffers": [{"byteLength": len(binary)}], "bufferViews": [{"buffer": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}], "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3", "min": [0, 0, 0], "max": [1, 1, 0]}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}]}
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(binary)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(binary), b"BIN\0") + binary


def test_mesh_readers(spark, tmp_path):
    (tmp_path / "q.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2/2 -2 -1\n")
    (tmp_path / "a.ply").write_bytes(ply(False))
    (tmp_path / "b.ply").write_bytes(ply(True))
    (tmp_path / "p.f32").write_bytes(np.arange(7, dtype="<f4").tobytes() + b"x")
    (tmp_path / "p.json").write_text('{"points": [[1, 2, 3]]}')
    (tmp_path / "m.glb").write_bytes(glb())
    got = {r.path.rsplit("/", 1)[1]: r for r in meshes.read_meshes(spark, str(tmp_path)).collect()}
    square = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    assert all((got[n].vertices, got[n].faces) == (square, [[0, 1, 2], [0, 2, 3]]) for n in ("q.obj", "a.ply", "b.ply"))
    assert got["p.f32"].vertices == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]] and got["p.json"].vertices == [[1.0, 2.0, 3.0]]
    assert got["m.glb"].vertices == [[0.0, -2.0, 0.0], [1.0, -2.0, 0.0], [0.0, -2.0, 1.0]] and meshes.glb_bounds(glb()) == ([0, 0, 0], [1, 1, 0])
    one = meshes.read_meshes(spark, str(tmp_path), spark.createDataFrame([(got["q.obj"].path,)], "path string"))
    assert one.count() == 1
    points = meshes.sample_surface(np.array(square), np.array([[0, 1, 2], [0, 2, 3]]), 200, 1)
    assert (points >= 0).all() and (points <= 1).all() and (points == meshes.sample_surface(np.array(square), np.array([[0, 1, 2], [0, 2, 3]]), 200, 1)).all()
    with pytest.raises(ValueError, match="big_endian"):
        meshes.parse_ply(ply(True).replace(b"little", b"big"))


def test_scene_readers(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    scene = '{"layout": {"center": [0, 0, 0], "size": [2, NaN, -1]}, "objects": [{"object_id": "a", "label": "x", "bbox": {"min_corner": [0, 0, 0], "max_corner": [1, 1, 1]}, "attributes": {"shape": [[1, 2, 3]]}}]}'
    (tmp_path / "m.jsonl").write_text('{"sample_id": "s", "input": "in.txt", "ground_truth": %s}\n' % scene)
    m = R.read_manifest(spark, str(tmp_path / "m.jsonl"))
    decoded = R.decoded(m, "gt")
    r = decoded.select(R.oriented(F.col("layout")).alias("o"), R.aligned(F.col("layout")).alias("a")).first()
    assert r.o.size == [2.0, 0.0, 0.0] and r.a is None
    assert keys(R.objects(decoded), "obj_idx", "score", "attributes")[0] == (0, 1.0, {"shape": "[[1,2,3]]"}) and R.relations(decoded).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"sample_id": "s"}\n')
    with pytest.raises(Exception, match="input is missing"):
        R.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "gone.jsonl").write_text('{"sample_id": "s", "input": "nowhere.txt"}\n')
    with pytest.raises(Exception, match="does not exist"):
        R.read_manifest(spark, str(tmp_path / "gone.jsonl")).collect()
    (tmp_path / "preds").mkdir()
    with pytest.raises(Exception, match="no prediction for s|PATH_NOT_FOUND|UNABLE"):
        R.read_predictions(spark, str(tmp_path / "preds"), m).collect()
    out = spark.createDataFrame([(0, '{"metadata": {"sample_id": "s"}, "k": 1}'), (1, '{"sample_id": "s", "k": 2}')], "pos int, value string")
    assert json.loads(R.match_outputs(m, out).first().prediction)["k"] == 2
    with pytest.raises(ValueError, match="no output for s"):
        R.match_outputs(m, out.limit(0))
