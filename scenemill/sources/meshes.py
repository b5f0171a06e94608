"""Mesh and point files: OBJ, PLY (ASCII and binary little-endian), raw float32, JSON, and GLB.

Files are read by Spark as binary rows and parsed in Arrow functions, each on its own: path, vertices,
faces (triangles). Polygons become fans. What a format forbids here (big-endian PLY, sparse or external
buffers, compression) is an error that names the file.
"""

from __future__ import annotations

import json
import random
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import opened, read_members
from .scenes import plain

# fixed values: PLY's scalar names and glTF's component types
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
GLTF_TYPES = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
GLTF_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}

Mesh = tuple[np.ndarray, np.ndarray]


def fan(polygon: list[int]) -> list[tuple[int, int, int]]:
    return [(polygon[0], a, b) for a, b in zip(polygon[1:], polygon[2:])]


def _mesh(vertices, faces) -> Mesh:
    return np.array(vertices, float).reshape(-1, 3), np.array(faces, int).reshape(-1, 3)


def parse_obj(data: bytes) -> Mesh:
    """1-based indices; negative ones count from the last vertex read."""
    vertices, faces = [], []
    for line in data.decode().splitlines():
        kind, *rest = line.split() or [""]
        if kind == "v":
            vertices.append([float(x) for x in rest[:3]])
        elif kind == "f":
            index = [int(x.split("/")[0]) for x in rest]
            faces += fan([i - 1 if i > 0 else len(vertices) + i for i in index])
    return _mesh(vertices, faces)


def parse_ply(data: bytes) -> Mesh:
    end = data.find(b"\n", data.index(b"end_header"))  # after a line feed, with or without a carriage return
    head, body = data[:end], data[end + 1 :]
    lines = [x.split() for x in head.decode("ascii").splitlines()]
    form = next(x[1] for x in lines if x and x[0] == "format")
    elements: list[tuple[str, int, list]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append((x[-1], *x[1:-1]))
    if form == "ascii":
        tokens = iter(body.split())
        take = lambda kind: float(next(tokens)) if PLY_TYPES[kind][-2] == "f" else int(next(tokens))
    elif form == "binary_little_endian":
        at = 0

        def take(kind):
            nonlocal at
            value = np.frombuffer(body, PLY_TYPES[kind], 1, at)[0]
            at += value.itemsize
            return value.item()
    else:
        raise ValueError(f"PLY format {form} is not read")
    vertices, faces = [], []
    for name, count, properties in elements:
        for _ in range(count):
            row = {p: [take(kind[2]) for _ in range(int(take(kind[1])))] if kind[0] == "list" else take(kind[0]) for p, *kind in properties}
            if name == "vertex":
                vertices.append([row["x"], row["y"], row["z"]])
            elif name == "face":
                faces += fan(next(v for v in row.values() if isinstance(v, list)))
    return _mesh(vertices, faces)


def parse_f32(data: bytes) -> Mesh:
    """Triples of little-endian float32; what is left over at the end is dropped."""
    return _mesh(np.frombuffer(data, "<f4", len(data) // 12 * 3), [])


def parse_json(data: bytes) -> Mesh:
    found = json.loads(data)
    return _mesh(found["points"] if isinstance(found, dict) else found, [])


def glb_parts(data: bytes) -> tuple[dict, bytes]:
    magic, version, length = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2 or length != len(data):
        raise ValueError("not a whole GLB 2 file")
    size = struct.unpack_from("<I", data, 12)[0]
    return json.loads(data[20 : 20 + size]), data[28 + size :]


def _accessor(doc: dict, binary: bytes, number: int) -> np.ndarray:
    a = doc["accessors"][number]
    if "sparse" in a or "bufferView" not in a:
        raise ValueError("sparse accessors are not read")
    view, kind, width = doc["bufferViews"][a["bufferView"]], np.dtype(GLTF_TYPES[a["componentType"]]), GLTF_WIDTH[a["type"]]
    if "uri" in doc["buffers"][view["buffer"]]:
        raise ValueError("external buffers are not read")
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = view.get("byteStride", kind.itemsize * width)
    return np.ndarray((a["count"], width), kind, binary, start, (stride, kind.itemsize))


def _local(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    turned = np.array(node.get("rotation", (0, 0, 0, 1)), float)
    x, y, z, w = turned / (np.linalg.norm(turned) or 1.0)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = turn * np.array(node.get("scale", (1, 1, 1))), node.get("translation", (0, 0, 0))
    return out


def parse_glb(data: bytes) -> Mesh:
    """All triangles of the scene with z up: (x, y, z) of the file becomes (x, -z, y)."""
    doc, binary = glb_parts(data)
    if any(k in doc for k in ("extensionsRequired", "skins")):
        raise ValueError("compressed or skinned meshes are not read")
    vertices, faces, total = [], [], 0
    todo = [(n, np.eye(4), ()) for n in doc["scenes"][doc.get("scene", 0)]["nodes"]]
    while todo:
        number, above, path = todo.pop()
        if number in path:
            raise ValueError("the scene graph has a cycle")
        node = doc["nodes"][number]
        world = above @ _local(node)
        todo += [(c, world, (*path, number)) for c in node.get("children", ())]
        for part in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else ():
            if part.get("mode", 4) != 4 or "targets" in part or part.get("extensions"):
                raise ValueError("only plain triangles are read")
            v = _accessor(doc, binary, part["attributes"]["POSITION"]).astype(float) @ world[:3, :3].T + world[:3, 3]
            index = _accessor(doc, binary, part["indices"]).ravel().astype(int) if "indices" in part else np.arange(len(v))
            if len(index) % 3 or len(index) and not 0 <= index.min() <= index.max() < len(v):
                raise ValueError("indices do not make triangles of the part's vertices")
            vertices.append(np.column_stack([v[:, 0], -v[:, 2], v[:, 1]]))
            faces.append(index + total)
            total += len(v)
    if not sum(map(len, faces)):
        raise ValueError("there are no triangles")
    v = np.concatenate(vertices)
    if not np.isfinite(v).all():
        raise ValueError("a vertex is not finite")
    return _mesh(v, np.concatenate(faces))


def glb_bounds(head: bytes) -> tuple[list[float], list[float]]:
    """Least and greatest corner from the accessors' own bounds; needs the first chunk only."""
    size = struct.unpack_from("<I", head, 12)[0]
    doc = json.loads(head[20 : 20 + size])
    used = {p["attributes"]["POSITION"] for m in doc["meshes"] for p in m["primitives"]}
    low = np.min([doc["accessors"][a]["min"] for a in used], axis=0)
    high = np.max([doc["accessors"][a]["max"] for a in used], axis=0)
    return low.tolist(), high.tolist()


PARSERS = {"obj": parse_obj, "ply": parse_ply, "f32": parse_f32, "bin": parse_f32, "json": parse_json, "glb": parse_glb}


def read_meshes(spark: SparkSession, path: str | list[str], wanted: DataFrame | None = None) -> DataFrame:
    """path, vertices, faces of the files below a folder, or several. wanted: only those whose path it has, scheme aside, found before any is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if wanted is not None:
        names = wanted.select(plain(F.col("path")).alias("_p")).distinct()
        files = files.join(names, plain(F.col("path")) == F.col("_p"), "left_semi")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    v, f = PARSERS[name.rsplit(".", 1)[-1].lower()](data)
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tolist()], pa.list_(pa.list_(pa.float64()))), pa.array([f.tolist()], pa.list_(pa.list_(pa.int32())))], names=["path", "vertices", "faces"])

    return files.select("path", "content").mapInArrow(parse, "path string, vertices array<array<double>>, faces array<array<int>>")


def head_of(path: str) -> bytes:
    """A GLB file up to the end of its first chunk."""
    with opened(path) as f:
        start = f.read(20)
        return start + f.read(struct.unpack_from("<I", start, 12)[0])


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """path, low, high of every GLB file below a folder, from its accessors' own bounds. Files are listed by Spark and read up to the end of their head."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [glb_bounds(head_of(name)) for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.list_(pa.float64())) for k in (0, 1)]], names=["path", "low", "high"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.glb").load(path)
    return files.select("path").mapInArrow(scan, "path string, low array<double>, high array<double>")


def room_files(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """room_id, file of <path>/<house>/<room>/*.glb, contents unread. wanted: rooms (room_id) that must be there; others go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.glb").load(path)
    parts = F.split("path", "/")
    named = files.select(F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2)).alias("room_id"), F.element_at(parts, -1).alias("file"))
    if wanted is None:
        return named
    lost = wanted.select("room_id").distinct().join(named, "room_id", "left_anti").orderBy("room_id").limit(6).collect()
    if lost:
        raise ValueError(f"listed rooms without a GLB file: {', '.join(r[0] for r in lost[:5])}")
    return named.join(wanted.select("room_id").distinct(), "room_id", "left_semi")


def furniture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Furniture of source scenes, (house, jid, size, category, title), and of placed pieces, (house, room, jid, pos, size).

    path: a folder of <house>.json, or a ZIP archive that holds such files in any of its folders.

    A size is three numbers, possibly in lists of one; a placed piece's is stretched by its scale. Pieces without a size or
    with a scale that is not three finite numbers are left out.
    """
    piece = "struct<uid:string,jid:string,size:string,bbox:string,sourceCategoryId:string,title:string>"
    kind = f"furniture array<{piece}>, scene struct<room:array<struct<instanceid:string,children:array<struct<ref:string,scale:array<double>>>>>>"
    if path.lower().endswith(".zip"):
        files = read_members(spark, path, "*.json").select("name", F.decode("content", "UTF-8").alias("value"))
    else:
        files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    scene = files.select(F.regexp_extract("name", r"([^/]*)\.json$", 1).alias("house"), F.from_json("value", kind).alias("s"))
    flat = lambda c: F.transform(F.from_json(F.regexp_replace(F.regexp_replace(c, r"^\[+", "["), r"\]+$", "]"), "array<double>"), F.abs)
    items = scene.select("house", F.explode("s.furniture").alias("f")).where("f.jid <> ''").select(
        "house", "f.uid", "f.jid", flat(F.coalesce("f.size", "f.bbox")).alias("size"), F.col("f.sourceCategoryId").alias("category"), F.col("f.title").alias("title")
    )
    sized = items.where(F.size("size") == 3)
    child = scene.select("house", F.explode("s.scene.room").alias("r")).select("house", F.col("r.instanceid").alias("room"), F.posexplode("r.children").alias("pos", "c"))
    factor = F.coalesce(F.col("c.scale"), F.array(*[F.lit(1.0)] * 3))
    sound = (F.size(factor) == 3) & F.forall(factor, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    placed = child.where(sound).withColumns({"uid": F.col("c.ref"), "_f": factor}).join(sized.select("house", "uid", "jid", "size"), ["house", "uid"])
    return sized.drop("uid"), placed.select("house", "room", "jid", "pos", F.zip_with("size", F.transform("_f", F.abs), lambda a, b: a * b).alias("size"))


def ply_bytes(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A mesh as a binary little-endian PLY file."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.empty(len(faces), np.dtype([("n", "u1"), ("i", "<i4", 3)]))
    rows["n"], rows["i"] = 3, np.asarray(faces, int).reshape(-1, 3)
    return head.encode() + np.asarray(vertices, "<f4").tobytes() + rows.tobytes()


def f32_bytes(points: np.ndarray) -> bytes:
    return np.asarray(points, "<f4").tobytes()


def packed_meshes(meshes: DataFrame) -> DataFrame:
    """path, ply, f32 of meshes (path, vertices, faces): files as binary columns, for a writer of binary data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(np.array(v, float).reshape(-1, 3), np.array(f, int).reshape(-1, 3)) for v, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ply_bytes(*m) for m in held], pa.binary()), pa.array([f32_bytes(v) for v, _ in held], pa.binary())], names=["path", "ply", "f32"])

    return meshes.select("path", "vertices", "faces").mapInArrow(pack, "path string, ply binary, f32 binary")


def sampled_clouds(meshes: DataFrame, count: int, seed: int) -> DataFrame:
    """path, cloud: `count` points over the faces of each mesh, every mesh with a fresh generator; files of bare points as they are."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v, f = np.array(v, float).reshape(-1, 3), np.array(f, int).reshape(-1, 3)
                out.append((sample_surface(v, f, count, seed) if len(f) else v).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["path", "cloud"])

    return meshes.select("path", "vertices", "faces").mapInArrow(draw, "path string, cloud array<array<double>>")


def sample_surface(vertices: np.ndarray, faces: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Points drawn evenly over a mesh's triangles by Python's own generator; without area, the vertices in turn."""
    corner = vertices[faces]
    area = np.linalg.norm(np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0]), axis=1) / 2
    if not len(area) or area.sum() <= 0:
        return vertices[np.arange(count) % len(vertices)]
    draw, upto = random.Random(seed), np.cumsum(area)
    out = np.empty((count, 3))
    for k in range(count):
        a, b, c = corner[min(int(np.searchsorted(upto, draw.random() * upto[-1], side="right")), len(area) - 1)]
        root, share = draw.random() ** 0.5, draw.random()
        out[k] = (1 - root) * a + root * (1 - share) * b + root * share * c
    return out
