"""COCO documents and heads of pictures."""

import json
import struct
from pathlib import Path

from scenemill.operators import ground_truth
from scenemill.sources import pictures


def test_a_coco_document_per_split(spark, tmp_path):
    images = spark.createDataFrame([("train", i, f"rgb/{i}.png") for i in (3, 1, 2)] + [("val", 9, "rgb/9.png")], "split string, id long, file_name string").repartition(3)
    notes = spark.createDataFrame([("train", i, 1 + i % 3, [1.0, 2.0, 3.0, 4.5]) for i in range(20)], "split string, id long, image_id long, bbox array<double>").repartition(4)
    classes = spark.createDataFrame([(2, "sofa", "furniture"), (1, "chair", "furniture")], "id long, name string, supercategory string")
    ground_truth.write_coco(images, notes, classes, f"{tmp_path}/coco", {"projection": "equirectangular"})
    for split, ids, many in (("train", [1, 2, 3], 20), ("val", [9], 0)):
        files = list(Path(tmp_path, "coco", f"split={split}").glob("*.txt"))
        assert len(files) == 1
        found = json.loads(files[0].read_text())
        assert found["info"] == {"projection": "equirectangular", "split": split} and found["licenses"] == []
        assert found["categories"] == [{"id": 1, "name": "chair", "supercategory": "furniture"}, {"id": 2, "name": "sofa", "supercategory": "furniture"}]
        assert [i["id"] for i in found["images"]] == ids and [a["id"] for a in found["annotations"]] == list(range(many))
        assert all(a["bbox"] == [1.0, 2.0, 3.0, 4.5] and set(a) == {"id", "image_id", "bbox"} for a in found["annotations"])
    again = ground_truth.read_coco(spark, f"{tmp_path}/coco", "id long, file_name string", "id long, image_id long, bbox array<double>")
    for got, given in zip(again, (images, notes)):
        assert sorted(map(tuple, got.select(given.columns).collect())) == sorted(map(tuple, given.collect()))


def test_sizes_of_pictures(spark, tmp_path):
    png = pictures.PNG + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 1024, 512, 8, 2, 0, 0, 0) + bytes(100)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xff\xdb" + struct.pack(">H", 67) + bytes(65) + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 480, 640) + bytes(12)
    for name, data in (("a.png", png), ("b/c.jpg", jpeg), ("b/d.jpeg", b"\xff\xd8\xff"), ("e.png", b"text"), ("f.txt", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.input.rsplit("/", 1)[-1]: (r.width, r.height) for r in pictures.picture_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (1024, 512), "c.jpg": (640, 480), "d.jpeg": (None, None), "e.png": (None, None)}
