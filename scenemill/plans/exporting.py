"""Queries of the ground-truth, panorama, plane and check operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import as_oriented, bounds, corners, sanitized
from ..operators import checks as K, curation as C, ground_truth as G, panoramas as P, planes as L, scene_metrics as M, scenes as S
from ..operators.ranking import checkpointed
from . import views as V
from .curating import _CATEGORY, _POINT, _RING, _ringed
from .scoring import THRESHOLD, _match_sql, rounded
from .views import VIEW_SQL, table

WIDTH, HEIGHT = 16, 8


def _shape_names(spark, sf, objects, step):
    """The vector whose points an object has, dealt over all vectors and a hundred that are not there."""
    vectors = table(spark, sf, "embeddings").agg((F.max("vec_id") + 101).alias("_n"))  # one row
    vec = F.pmod(F.col("sample_id") * 7 + F.col("obj_idx") + step, F.col("_n"))
    return objects.select("sample_id", "obj_idx").join(F.broadcast(vectors)).select("sample_id", "obj_idx", vec.alias("shape"))


def shape_metrics(spark, sf):
    preds, labels = checkpointed(V.pred_objects(spark, sf)), checkpointed(V.gt_objects(spark, sf))
    shapes = V.points(spark, sf).select(F.col("obj_id").alias("shape"), "cloud")
    scores = M.shape_scores(preds, labels, _shape_names(spark, sf, preds, 0), _shape_names(spark, sf, labels, 1), THRESHOLD, "canonical", fscore_threshold=0.25, shapes=shapes)
    return rounded(scores, "chamfer", "fscore")


def layout_relations(spark, sf):
    objects = V.gt_objects(spark, sf).select("sample_id", "obj_idx", F.col("obj_idx").cast("string").alias("object_id"), as_oriented(F.col("box")).alias("box"))
    return S.relations(objects, _ringed(spark, sf).drop("cx", "cy"))


def relation_counts(spark, sf):
    return layout_relations(spark, sf).groupBy("relation_type").agg(F.count("*").alias("n"))


def upright_boxes(spark, sf):
    p = V.points(spark, sf).select("obj_id", F.explode("cloud").alias("p")).select("obj_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"))
    b = G.upright_boxes(p, "obj_id")
    out = b.select("obj_id", *[F.col("center")[i].alias(f"c{i}") for i in range(3)], *[F.col("size")[i].alias(f"s{i}") for i in range(3)], F.col("basis")[0][0].alias("ax"), F.col("basis")[0][1].alias("ay"))
    return rounded(out, *out.columns[1:])


def _rooms(spark, sf):
    s = V.scenes(spark, sf).where("gt_layout is not null")
    return s.select(F.col("sample_id").alias("room_id"), F.col("gt_layout.x1").alias("x"), F.col("gt_layout.y1").alias("y"), F.col("gt_layout.z1").alias("z"))


def _centred(spark, sf):
    o = as_oriented(F.col("box"))
    return V.gt_objects(spark, sf).select(F.col("sample_id").alias("room_id"), "obj_idx", o["center"].alias("center"), o["size"].alias("size"))


def view_objects(spark, sf):
    """One or two views of each room."""
    view = F.explode(F.sequence(F.lit(0).cast("long"), F.col("room_id") % 2)).alias("view")
    views = _rooms(spark, sf).select("*", view).select(F.concat_ws("/", "room_id", "view").alias("sample_id"), "room_id", F.array(F.col("x") / 4, F.col("y") / 4, 1 + F.col("view") / 10).alias("camera"))
    scales = _rooms(spark, sf).select("room_id", (1 + F.col("room_id") % 5 / 10).alias("scale"))
    seen = G.view_objects(views, _centred(spark, sf), scales)
    out = seen.select("sample_id", "obj_idx", *[F.col("center")[i].alias(f"c{i}") for i in range(3)], *[F.col("size")[i].alias(f"s{i}") for i in range(3)])
    return rounded(out, *out.columns[2:])


def layout_in_camera(spark, sf):
    rooms = _ringed(spark, sf).select("sample_id", "ring", "floor_z", "ceiling_z", F.array("cx", "cy", F.col("ceiling_z") / 2).alias("camera"), (1 + F.col("sample_id") % 5 / 10).alias("scale"), F.lit(2.0).alias("area"))
    out = G.moved_layout(rooms, "camera", "scale").select("sample_id", "floor_z", "ceiling_z", "area", F.col("ring")[2][0].alias("px"), F.col("ring")[3][1].alias("py"))
    return rounded(out, *out.columns[1:])


def training_classes(spark, sf):
    models = table(spark, sf, "part").where("p_size % 3 <> 0").select(F.col("p_partkey").alias("model"), F.col("p_type").alias("class"), F.col("p_brand").alias("fine"))
    objects = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("model"), F.col("l_returnflag").alias("label"))
    return G.training_classes(objects, models).groupBy("class", "fine").agg(F.count("*").alias("n"))


def labels_by_file(spark, sf):
    o = V._lines(spark, sf)
    objects = o.where("l_partkey % 3 <> 0").select("sample_id", "obj_idx", "label", F.concat(F.lit("rooms/"), F.col("sample_id").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".glb")).alias("source_glb"))
    drawn = o.select("sample_id", F.col("obj_idx").alias("instance"), F.concat(F.lit("/scratch/"), F.col("l_partkey").cast("string"), F.lit(".glb")).alias("source_file"))
    return G.labels_by_file(drawn, objects).select("sample_id", "instance", "label")


def instance_scale(spark, sf):
    o = V._lines(spark, sf)
    edge = F.array(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0"))
    k = 1.5 + (F.col("l_partkey") % 5).cast("double") / 20
    real = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.array(edge[0] * k, edge[1] * k, edge[2] * 3 * k).alias("real")), F.struct(F.lit(1).alias("pos"), F.array(edge[0] * k * 1.01, edge[1] * k, edge[2] * k).alias("real"))))
    c = o.select(F.col("sample_id").alias("room"), F.col("obj_idx").alias("obj"), edge.alias("model"), real.alias("c")).select("room", "obj", "model", "c.*")
    return rounded(G.scale_of(G.best_instance(c)), "scale", "spread")


def published_scenes(spark, sf):
    o = F.struct(F.col("obj_idx").alias("object_id"), F.create_map(F.lit("shape"), F.lit("a.ply"), F.lit("source_glb"), F.col("label")).alias("attributes"))
    scenes = V.gt_objects(spark, sf).groupBy("sample_id").agg(F.collect_list(o).alias("objects")).withColumn("split", F.lit("train"))
    out = G.published(scenes.withColumn("sample_id", F.col("sample_id").cast("string")))
    return out.select("path", F.size("objects").alias("n"), F.aggregate("objects", F.lit(0), lambda s, x: s + F.size(x["attributes"])).alias("attributes"))


def seam_pieces(spark, sf):
    """A mask per user: pixels from its events."""
    pixels = table(spark, sf, "events").select(F.col("user_id").alias("mask"), (F.col("event_id") % 16).alias("row"), ((F.col("event_id") * 7 + F.col("user_id")) % 48 + F.when(F.col("user_id") % 3 == 0, 16).otherwise(0)).alias("col")).distinct()
    pixels = pixels.where(~((F.col("mask") % 4 == 1) & F.col("col").between(10, 20)) & ~((F.col("mask") % 4 == 2) & F.col("col").between(1, 30)))
    return P.seam_pieces(pixels, "mask", 48)


def corner_pixels(spark, sf):
    c = P.corner_pixels(F.col("ring"), F.array("cx", "cy", F.col("ceiling_z") / 2), F.col("floor_z"), F.col("ceiling_z"), WIDTH, HEIGHT)
    return rounded(_ringed(spark, sf).select("sample_id", F.posexplode(c).alias("n", "c")).select("sample_id", "n", "c.*"), "x", "ceiling_y", "floor_y")


def camera_faults(spark, sf):
    """Cameras inside an L-shaped room, on its corner, on an edge, in the part that it lacks, beyond it, or at the ceiling."""
    r, k = _ringed(spark, sf), F.col("sample_id") % 7
    x, y, z = F.array_max(F.transform("ring", lambda p: p[0])), F.array_max(F.transform("ring", lambda p: p[1])), F.col("ceiling_z")
    px = F.when(k == 1, 0.0).when(k == 2, x * 0.75).when(k == 3, x / 2).when(k == 5, x * 2).when(k == 6, x * 0.75).otherwise(x / 4)
    py = F.when(k == 1, 0.0).when(k.isin(2, 3), y * 0.75).otherwise(y / 4)
    camera = F.array(px, py, F.when(k == 4, z).when(k == 5, z + 1).otherwise(z / 2))
    placed = r.select("sample_id", F.array("ring").alias("rings"), camera.alias("camera"), "floor_z", "ceiling_z")
    return placed.select("sample_id", F.array_join(P.camera_faults(F.col("rings"), F.col("camera"), F.col("floor_z"), F.col("ceiling_z")), ",").alias("faults"))


def _targets(spark, sf, camera_z):
    rooms = _ringed(spark, sf).select("sample_id", "ring", "floor_z", "ceiling_z", F.array("cx", "cy", camera_z).alias("camera"))
    return P.layout_targets(rooms, WIDTH)


def layout_targets(spark, sf):
    t = _targets(spark, sf, F.col("ceiling_z") / 2).select("sample_id", F.posexplode(F.arrays_zip("ranges", "ceiling", "floor", "corner")).alias("col", "t")).select("sample_id", "col", "t.*")
    return rounded(t, "ranges", "ceiling", "floor", "corner")


def target_faults(spark, sf):
    """Targets of cameras of which some stand above the ceiling."""
    t = _targets(spark, sf, F.when(F.col("sample_id") % 13 == 0, F.col("ceiling_z") + 1).otherwise(F.col("ceiling_z") / 2))
    faults = P.target_faults(F.col("ceiling"), F.col("floor"), F.col("corner"), F.col("ranges"), WIDTH)
    return t.select("sample_id", F.array_join(faults, ",").alias("faults")).where("faults <> ''")


def image_statistics(spark, sf):
    e = F.col("event_id")
    pixels = table(spark, sf, "events").select(F.col("user_id").alias("image"), (e % 256).alias("r"), (e * 3 % 256).alias("g"), F.when(F.col("user_id") % 7 == 0, e * 3 % 256).otherwise(e * 5 % 256).alias("b"), (F.col("value") / 10).alias("depth"))
    stats = P.image_statistics(pixels, "image", F.lit(3.0))
    out = stats.withColumn("flags", F.array_join("flags", ","))
    return rounded(out, *[c for c in out.columns if c not in ("image", "flags")])


def id_differences(spark, sf):
    found = table(spark, sf, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("id"))
    expected = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"))
    return K.id_differences(found, expected, "id")


def split_differences(spark, sf):
    rooms = V.rooms(spark, sf).select("room_id", "split")
    changed = rooms.withColumn("split", F.when(F.col("room_id").endswith("7"), "test").otherwise(F.col("split")))
    return K.row_differences(changed, rooms)


def exclusion_plan(spark, sf):
    """Rooms of customers without enough frames; a third has no reason on record."""
    c = table(spark, sf, "customer").select(F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string")).alias("room_id"), "c_custkey")
    frames = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("frame"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(10).alias("bytes"))
    missing = C.unrendered(c.withColumnRenamed("room_id", "r").withColumnRenamed("c_custkey", "room_id"), frames.withColumnRenamed("c_custkey", "room_id")).select(F.col("r").alias("room_id"))
    reasons = c.select("room_id", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string"))).alias("reason"))
    plan, unexplained = K.exclusions_of(missing, reasons, "log")
    return plan.select("room_id", "house_id", "reason").unionByName(unexplained, allowMissingColumns=True)


def room_review(spark, sf):
    k = F.col("o_orderkey")
    rooms = table(spark, sf, "orders").select(
        k.alias("room_id"), F.when(k % 29 == 0, "open").alias("geometry_error"), (k % 11 / 10).alias("ratio"), (0.5 + k % 400).alias("area"), (0.5 + k % 37).alias("extent"), F.when(k % 31 == 0, "none").alias("camera_error"),
    )
    listed = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(k.alias("room_id"))
    return K.reviewed(rooms, listed).select("room_id", "exclusion")


def greedy_house_split(spark, sf):
    return K.greedy_house_split(V.rooms(spark, sf)).groupBy("split").agg(F.count("*").alias("rooms"), F.countDistinct("house_id").alias("houses"))


def keyed_house_fill(spark, sf):
    return K.greedy_house_split(V.rooms(spark, sf), order="keyed").groupBy("house_id", "split").agg(F.count("*").alias("rooms"))


def scene_faults(spark, sf):
    """Scenes of turned boxes; some pictures, layouts, labels and axes are wrong."""
    k, turn = F.col("sample_id"), F.radians((F.col("sample_id") % 12 * 15).cast("double"))
    long = F.when(F.col("l_partkey") % 17 == 0, 1.1).otherwise(1.0)
    basis = F.array(F.array(F.cos(turn) * long, F.sin(turn) * long, F.lit(0.0)), F.array(-F.sin(turn), F.cos(turn), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    o = F.struct("label", F.array("x0", "y0", "z0").alias("center"), F.array(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0")).alias("size"), basis.alias("basis"))
    objects = V._lines(spark, sf).where("label <> 'N' or l_suppkey % 10 = 0").select("sample_id", o.alias("o")).groupBy("sample_id").agg(F.collect_list("o").alias("objects"))
    rooms = _rooms(spark, sf).select(
        F.col("room_id").alias("sample_id"), F.when(F.col("room_id") % 19 == 0, 1000).otherwise(1024).alias("width"), F.lit(512).alias("height"),
        F.array(*[-F.col(c) / 2 for c in "xyz"]).alias("low"), F.array(F.col("x") / 2, F.col("y") / 2, F.when(F.col("room_id") % 21 == 0, -1.0).otherwise(F.col("z"))).alias("high"),
    )
    return K.scene_faults(rooms.join(objects, "sample_id"), ["A", "R"])


def _audited(spark, sf):
    k = F.col("o_orderkey")
    flag = lambda c, f: F.when(c, F.lit(f))
    rooms = table(spark, sf, "orders").select(k.alias("room_id"), (k % 10 / 10).alias("fill"), F.array_compact(F.array(
        flag(k % 5 == 0, "oversized_source_object_requires_review"), flag(k % 9 == 0, "ceiling_height_requires_review"), flag(k % 14 == 0, "floor_layout_mismatch"),
    )).alias("flags"))
    views = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("room_id"), (F.col("l_partkey") % 50).cast("string").alias("rgb_sha256"), F.array_compact(F.array(
        flag(F.col("l_partkey") % 6 == 0, "mostly_dark"), flag(F.col("l_suppkey") % 10 == 0, "inside_furniture_bbox"),
    )).alias("flags"))
    return K.audited(rooms, views)


def audit_flags(spark, sf):
    return _audited(spark, sf).select("room_id", F.array_join("flags", ",").alias("flags"), "geometry_pass")


def flag_counts(spark, sf):
    return K.flag_counts(_audited(spark, sf))


def review_order(spark, sf):
    """The first hundred rooms to look at."""
    return K.review_order(_audited(spark, sf), 100).select("room_id", "geometry_pass")


def _triangles(spark, sf):
    """The two halves of each object's upper side."""
    at = lambda x, y, dz=0.0: F.array(F.col(x), F.col(y), F.col("z1") + dz)
    halves = F.explode(F.array(F.struct(at("x0", "y0").alias("a"), at("x1", "y0").alias("b"), at("x1", "y1").alias("c")), F.struct(at("x0", "y0").alias("a"), at("x1", "y1", 0.0531).alias("b"), at("x0", "y1").alias("c"))))
    return V._lines(spark, sf).select("sample_id", "obj_idx", halves.alias("t")).select("sample_id", "obj_idx", "t.*")


def vertical_hits(spark, sf):
    points = _rooms(spark, sf).select(F.col("room_id").alias("sample_id"), (F.col("x") / 4 + 0.0131592653).alias("x"), (F.col("y") / 4 + 0.0071828182).alias("y"))
    hits = L.vertical_hits(points, _triangles(spark, sf), "sample_id")
    return rounded(hits.groupBy("sample_id").agg(F.count("*").alias("hits"), F.min("z").alias("low"), F.max("z").alias("high")), "low", "high")


def level_planes(spark, sf):
    level = L.horizontal(_triangles(spark, sf)).where("faces_up").withColumn("z", (F.col("a")[2] + F.col("b")[2] + F.col("c")[2]) / 3)
    return rounded(L.planes(level, "sample_id", 0.25), "z", "area")


def furniture_anchor(spark, sf):
    return rounded(L.furniture_anchor(V.gt_objects(spark, sf), "sample_id"), "x", "y", "reach")


def farthest_object(spark, sf):
    return rounded(L.farthest(_centred(spark, sf), "room_id"), "distance")


def distinct_candidates(spark, sf):
    e = F.col("event_id")
    return L.distinct_candidates(table(spark, sf, "events").select(F.col("user_id").alias("room"), (e % 5 / 10).alias("x"), (e % 3 / 10 + F.when(e % 2 == 0, 1e-9).otherwise(0.0)).alias("y"), F.lit(0.0).alias("z"), F.col("value").alias("clearance")), "room").select("room", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "clearance")


def local_densities(spark, sf):
    out = L.local_densities(V.points(spark, sf), "obj_id", neighbours=5)
    return rounded(out.select("obj_id", F.explode("densities").alias("d")).groupBy("obj_id").agg(F.sum("d").alias("total"), F.max("d").alias("top")), "total", "top")


def structural_files(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("floor.glb", "wall.glb", "floor_lamp.glb", "ceil", "others.obj", "architecture.v2.glb", "chair.glb"))), F.col("l_linenumber") % 7 + 1)
    files = table(spark, sf, "lineitem").select(F.concat(F.lit("rooms/"), F.col("l_orderkey").cast("string"), F.lit("/"), name).alias("path"), name.alias("file"))
    return files.groupBy("file", K.is_structural(F.col("path")).alias("structural")).agg(F.count("*").alias("n"))


def room_list(spark, sf):
    return K.room_list(table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"))).alias("room_id")))


def paired_corners(spark, sf):
    corner = lambda p: F.array(F.struct(p[0].alias("x"), p[1].alias("y")), F.struct((p[0] + 0.4).alias("x"), (p[1] + 5).alias("y")))
    pairs = P.paired_by_column(F.flatten(F.transform("ring", corner)))
    return _ringed(spark, sf).select("sample_id", F.posexplode(pairs).alias("n", "c")).select("sample_id", "n", "c.x", "c.y")


def half_extent_boxes(spark, sf):
    """Boxes from half their edges, sanitised (some edges are negative or not a number), and the bounds around them."""
    turn = F.radians((F.col("sample_id") % 12 * 15).cast("double"))
    axes = F.array(F.array(F.cos(turn), F.sin(turn), F.lit(0.0)), F.array(-F.sin(turn), F.cos(turn), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    edge = F.when(F.col("l_partkey") % 11 == 0, -1.0).when(F.col("l_partkey") % 13 == 0, float("nan")).otherwise((F.col("x1") - F.col("x0")) / 2)
    made = sanitized(G.from_half_extents(F.array("x0", "y0", "z0"), F.array(edge, (F.col("y1") - F.col("y0")) / 2, (F.col("z1") - F.col("z0")) / 2), axes))
    b = bounds(corners(F.col("b")))
    return rounded(V._lines(spark, sf).select("sample_id", "obj_idx", made.alias("b")).select("sample_id", "obj_idx", *[b[c].alias(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1")]), "x0", "y0", "z0", "x1", "y1", "z1")


def resolved_scale(spark, sf):
    rooms = _rooms(spark, sf).select("room_id", F.col("z").alias("height"))
    known = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("room_id"), (1 + F.col("o_orderkey") % 4).cast("double").alias("scale"))
    return rounded(C.resolved_scale(rooms, known).select("room_id", "scale", "scale_source"), "scale")


def plausible_rooms(spark, sf):
    k = F.col("o_orderkey")
    reject, review = C.plausibility(k % 19 / 10, (0.5 + k % 400).cast("double"), (0.5 + k % 37).cast("double"))
    return table(spark, sf, "orders").select(k.alias("room_id"), F.array_join(reject, ",").alias("reject"), F.array_join(review, ",").alias("review"))


def mean_sizes(spark, sf):
    sizes = table(spark, sf, "lineitem").where("l_partkey % 10 < 7").select((F.col("l_partkey") % 10).alias("class"), F.col("l_quantity").alias("size"))
    return rounded(C.mean_sizes(sizes, table(spark, sf, "part").select((F.col("p_partkey") % 10).alias("class")).distinct()), "size")


def spread_sample(spark, sf):
    return C.spread_sample(table(spark, sf, "orders").select(F.col("o_custkey").alias("house"), F.col("o_orderkey").alias("room")), "house", F.col("room")).select("house", "room")


def padded_boxes(spark, sf):
    at = lambda c: F.col(c).cast("double")
    b = F.array(at("l_partkey") % 50, at("l_suppkey") % 40, F.col("l_quantity"), 1 + F.col("l_quantity") / 2)
    out = S.padded_box(b, F.lit(90), F.lit(60), 0.25)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", *[out[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def annotation_faults(spark, sf):
    """Runs of each user's events against a picture that is right for one in three; one box in seven is a single pixel."""
    pixels = table(spark, sf, "events").select(F.col("user_id").alias("mask"), F.col("event_id").alias("pos"), (F.col("value") > 50).cast("int").alias("on"))
    size = pixels.groupBy("mask").agg(F.count("*").alias("n"), F.sum("on").alias("held"))
    runs = S.mask_runs(pixels, "mask").join(size, "mask")
    m = F.col("mask")
    faults = S.annotation_faults(F.col("n"), F.when(m % 3 == 1, 2).otherwise(1), F.array(F.lit(0), F.lit(0), F.when(m % 7 == 0, 1).otherwise(F.col("n")) + F.when(m % 3 == 2, F.col("n")).otherwise(0), F.lit(1)), F.col("held") + F.when(m % 5 == 0, 1).otherwise(0), F.col("counts"))
    return runs.select("mask", F.array_join(faults, ",").alias("faults"))


QUERIES = {f.__name__: f for f in (
    shape_metrics, layout_relations, relation_counts, upright_boxes, view_objects, layout_in_camera, training_classes, labels_by_file, instance_scale, published_scenes, seam_pieces, corner_pixels, camera_faults,
    layout_targets, target_faults, image_statistics, id_differences, split_differences, exclusion_plan, room_review, greedy_house_split, keyed_house_fill, scene_faults, audit_flags, flag_counts, review_order,
    vertical_hits, level_planes, furniture_anchor, farthest_object, distinct_candidates, local_densities, structural_files, room_list, paired_corners, half_extent_boxes, resolved_scale,
    plausible_rooms, mean_sizes, spread_sample, padded_boxes, annotation_faults,
)}

_views = f"WITH {VIEW_SQL}"
_CANON = "(SELECT id, i, (x - ox) / s AS x, (y - oy) / s AS y, (z - oz) / s AS z FROM p JOIN (SELECT id, (min(x) + max(x)) / 2 AS ox, (min(y) + max(y)) / 2 AS oy, (min(z) + max(z)) / 2 AS oz, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS s FROM p GROUP BY id) USING (id))"
_near = lambda k: f"(SELECT sample_id, pair, avg(m) AS mean, avg((m <= 0.0625)::INT) AS share FROM (SELECT sample_id, pair, {k}, min(d) AS m FROM d GROUP BY ALL) GROUP BY ALL)"
_box = lambda k: f"(({k}0 + {k}1) / 2 - greatest({k}1 - {k}0 + 0.1::DOUBLE, 0.01::DOUBLE) / 2) AS {k}0, (({k}0 + {k}1) / 2 + greatest({k}1 - {k}0 + 0.1::DOUBLE, 0.01::DOUBLE) / 2) AS {k}1"
_meets = " AND ".join(f"least(a.{k}1, b.{k}1) > greatest(a.{k}0, b.{k}0)" for k in "xyz")
_RELATIONS = f"""{_views}, {_RING}, part AS (
  SELECT sample_id, 'layout::floor' AS target, 'touching_floor' AS relation_type, 0 AS x0, x AS x1, 0 AS y0, y AS y1, -0.025::DOUBLE AS z0, 0.025::DOUBLE AS z1 FROM scene WHERE has_gt
  UNION ALL SELECT sample_id, 'layout::ceiling', 'touching_ceiling', 0, x, 0, y, z - 0.025::DOUBLE, z + 0.025::DOUBLE FROM scene WHERE has_gt
  UNION ALL SELECT sample_id, 'layout::wall_' || e, 'touching_wall', least(px, qx) - (px = qx)::INT * 0.025::DOUBLE, greatest(px, qx) + (px = qx)::INT * 0.025::DOUBLE,
    least(py, qy) - (py = qy)::INT * 0.025::DOUBLE, greatest(py, qy) + (py = qy)::INT * 0.025::DOUBLE, 0, z FROM ring
), a AS (SELECT sample_id, obj_idx, {_box('x')}, {_box('y')}, {_box('z')} FROM gt), b AS (SELECT sample_id, target, relation_type, {_box('x')}, {_box('y')}, {_box('z')} FROM part), rel AS (
  SELECT a.sample_id, a.obj_idx::VARCHAR AS source, b.obj_idx::VARCHAR AS target, 'touching' AS relation_type FROM a JOIN a b ON a.sample_id = b.sample_id AND a.obj_idx < b.obj_idx AND {_meets}
  UNION ALL SELECT a.sample_id, a.obj_idx::VARCHAR, b.target, b.relation_type FROM a JOIN b ON a.sample_id = b.sample_id AND {_meets})"""
_RAY = "CASE WHEN abs(c) > 1e-10 THEN CASE WHEN t > 1e-7 AND w >= -1e-7 AND w <= 1 + 1e-7 THEN t END END"
_SIDES = f"""{_views}, {_RING}, side AS (SELECT sample_id, e, px - cx AS dx, py - cy AS dy, qx - px AS ex, qy - py AS ey FROM ring)"""
_hits = lambda rays: f"""SELECT sample_id, k, min({_RAY}) AS met FROM (SELECT *, (dx * ey - dy * ex) / nullif(c, 0) AS t, (dx * uy - dy * ux) / nullif(c, 0) AS w FROM (
  SELECT r.sample_id, k, ux, uy, dx, dy, ex, ey, ux * ey - uy * ex AS c FROM {rays} r JOIN side USING (sample_id))) GROUP BY ALL"""  # noqa: E731
_TARGETS = f"""{_SIDES}, turn AS (SELECT sample_id, i AS k, sin(((i + 0.5::DOUBLE) / {WIDTH} - 0.5::DOUBLE) * 2 * pi()) AS ux, cos(((i + 0.5::DOUBLE) / {WIDTH} - 0.5::DOUBLE) * 2 * pi()) AS uy FROM scene, range(0, {WIDTH}) r(i) WHERE has_gt),
far AS ({_hits('turn')}), vertex AS (SELECT sample_id, e AS k, sqrt(dx * dx + dy * dy) AS d, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM side),
seen AS (SELECT v.sample_id, (atan2(ux, uy) / (2 * pi()) + 0.5::DOUBLE - floor(atan2(ux, uy) / (2 * pi()) + 0.5::DOUBLE)) * {WIDTH} - 0.5::DOUBLE AS px FROM vertex v JOIN ({_hits('vertex')}) m USING (sample_id, k) WHERE abs(met - d) <= greatest(d * 1e-5, 1e-6)),
dist AS (SELECT sample_id, k, min(least(abs(k - px), {WIDTH} - abs(k - px))) AS away FROM far JOIN seen USING (sample_id) GROUP BY ALL)"""
_AUDIT = """WITH v AS (SELECT l_orderkey AS room_id, bool_or(l_partkey % 6 = 0) AS dark, bool_or(l_suppkey % 10 = 0) AS inside, count(DISTINCT l_partkey % 50) < count(*) AS twice FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS room_id, (o_orderkey % 10) / 10 AS fill, o_orderkey % 5 = 0 AS over, o_orderkey % 9 = 0 AS ceil, o_orderkey % 14 = 0 AS floor, coalesce(dark, false) AS dark, coalesce(inside, false) AS inside, coalesce(twice, false) AS twice
  FROM orders LEFT JOIN v ON room_id = o_orderkey),
a AS (SELECT room_id, fill, over, ceil, list_filter([CASE WHEN over THEN 'oversized_source_object_requires_review' END, CASE WHEN ceil THEN 'ceiling_height_requires_review' END, CASE WHEN floor THEN 'floor_layout_mismatch' END, CASE WHEN twice THEN 'duplicate_rgb' END,
  CASE WHEN inside THEN 'inside_furniture_bbox' END, CASE WHEN dark THEN 'mostly_dark' END], lambda x: x IS NOT NULL) AS flags, NOT (floor OR twice OR inside) AS geometry_pass FROM r)"""
_TRI = """t AS (SELECT sample_id, obj_idx, x0, y0, x1, y1, z1, h, x1 AS b_x, CASE h WHEN 0 THEN y0 ELSE y1 END AS b_y, CASE h WHEN 0 THEN z1 ELSE z1 + 0.0531::DOUBLE END AS b_z, CASE h WHEN 0 THEN x1 ELSE x0 END AS cx, y1 AS cy, z1 AS cz FROM line, range(0, 2) r(h))"""

ORACLE_SQL = {
    "keyed_house_fill": f"""WITH RECURSIVE {VIEW_SQL}, h AS MATERIALIZED (SELECT house_id, count(*) AS n, row_number() OVER (ORDER BY md5('0:' || house_id), house_id) AS r FROM room GROUP BY 1),
goal AS MATERIALIZED (SELECT sum(n)::DOUBLE * (1.0::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE) AS most, sum(n)::DOUBLE * 0.15::DOUBLE AS few FROM h),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS house_id, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, '' AS split UNION ALL
  SELECT r, house_id, n, a + CASE split WHEN 'train' THEN n ELSE 0 END, b + CASE split WHEN 'val' THEN n ELSE 0 END, c + CASE split WHEN 'test' THEN n ELSE 0 END, split FROM (
    SELECT h.r, h.house_id, h.n, a, b, c, CASE WHEN most - a >= few - b AND most - a >= few - c THEN 'train' WHEN few - b >= few - c THEN 'val' ELSE 'test' END AS split FROM f JOIN h ON h.r = f.r + 1, goal))
SELECT house_id, split, n AS rooms FROM f WHERE r > 0""",
    "shape_metrics": f"""WITH RECURSIVE {VIEW_SQL}, {_match_sql('sample_id')}, {_POINT}, n AS {_CANON}, pair AS (SELECT sample_id, obj_idx AS pair, (sample_id * 7 + obj_idx) % (SELECT max(vec_id) + 101 FROM embeddings) AS va, (sample_id * 7 + gt_idx + 1) % (SELECT max(vec_id) + 101 FROM embeddings) AS vb FROM walk WHERE gt_idx IS NOT NULL),
d AS (SELECT sample_id, pair, a.i AS ai, b.i AS bi, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d FROM pair JOIN n a ON a.id = va JOIN n b ON b.id = vb)
SELECT sample_id, round(avg(f.mean + g.mean), 6) AS chamfer, round(avg(CASE WHEN f.share + g.share > 0 THEN 2 * f.share * g.share / (f.share + g.share) ELSE 0 END), 6) AS fscore FROM {_near('ai')} f JOIN {_near('bi')} g USING (sample_id, pair) GROUP BY 1""",
    "layout_relations": f"{_RELATIONS} SELECT * FROM rel",
    "relation_counts": f"{_RELATIONS} SELECT relation_type, count(*) AS n FROM rel GROUP BY 1",
    "upright_boxes": f"""WITH {_POINT}, a AS (SELECT id, cos(t) AS ax, sin(t) AS ay FROM (SELECT id, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t FROM p GROUP BY 1)),
q AS (SELECT id, ax, ay, min(x * ax + y * ay) AS u0, max(x * ax + y * ay) AS u1, min(y * ax - x * ay) AS v0, max(y * ax - x * ay) AS v1, min(z) AS z0, max(z) AS z1 FROM p JOIN a USING (id) GROUP BY ALL)
SELECT id AS obj_id, round((u0 + u1) / 2 * ax - (v0 + v1) / 2 * ay, 6) AS c0, round((u0 + u1) / 2 * ay + (v0 + v1) / 2 * ax, 6) AS c1, round((z0 + z1) / 2, 6) AS c2, round(u1 - u0, 6) AS s0, round(v1 - v0, 6) AS s1, round(z1 - z0, 6) AS s2, round(ax, 6) AS ax, round(ay, 6) AS ay FROM q""",
    "view_objects": f"""{_views}, v AS (SELECT sample_id AS room, v, x, y, 1 + (sample_id % 5)::DOUBLE / 10 AS s FROM scene, range(0, 2) r(v) WHERE has_gt AND v <= sample_id % 2)
SELECT room || '/' || v AS sample_id, obj_idx, round(((x0 + x1) / 2 - x / 4) * s, 6) + 0::DOUBLE AS c0, round(((y0 + y1) / 2 - y / 4) * s, 6) + 0::DOUBLE AS c1, round(((z0 + z1) / 2 - (1 + v::DOUBLE / 10)) * s, 6) + 0::DOUBLE AS c2, round((x1 - x0) * s, 6) AS s0, round((y1 - y0) * s, 6) AS s1, round((z1 - z0) * s, 6) AS s2
FROM v JOIN gt ON gt.sample_id = room WHERE least(x1 - x0, y1 - y0, z1 - z0) > 1e-7""",
    "layout_in_camera": f"{_views}, q AS (SELECT *, 1 + (sample_id % 5)::DOUBLE / 10 AS k FROM scene WHERE has_gt) SELECT sample_id, round(-z / 2 * k, 6) AS floor_z, round(z / 2 * k, 6) AS ceiling_z, round(2 * k * k, 6) AS area, round((x - x / 4) * k, 6) AS px, round((y / 2 - y / 4) * k, 6) AS py FROM q",
    "training_classes": "SELECT CASE WHEN p_partkey IS NULL THEN 'other' ELSE p_type END AS class, p_brand AS fine, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 3 <> 0) ON l_partkey = p_partkey GROUP BY ALL",
    "labels_by_file": f"{_views}, o AS (SELECT sample_id, l_partkey, max_by(label, obj_idx) AS label FROM line WHERE l_partkey % 3 <> 0 GROUP BY ALL) SELECT sample_id, obj_idx AS instance, o.label FROM line JOIN o USING (sample_id, l_partkey)",
    "instance_scale": f"""{_views}, e AS (SELECT sample_id AS room, obj_idx AS obj, pos, list_sort([x1 - x0, y1 - y0, z1 - z0]) AS m, list_sort(CASE pos WHEN 0 THEN [(x1 - x0) * k, (y1 - y0) * k, (z1 - z0) * 3 * k] ELSE [(x1 - x0) * k * 1.01::DOUBLE, (y1 - y0) * k, (z1 - z0) * k] END) AS r
  FROM (SELECT *, 1.5::DOUBLE + (l_partkey % 5)::DOUBLE / 20 AS k FROM line), range(0, 2) q(pos) WHERE least(x1 - x0, y1 - y0, z1 - z0) > 1e-6),
q AS (SELECT *, [r[1] / m[1], r[2] / m[2], r[3] / m[3]] AS ratios FROM e), b AS (SELECT room, obj, ratios FROM q QUALIFY row_number() OVER (PARTITION BY room, obj ORDER BY greatest(ratios[1], ratios[2], ratios[3]) / greatest(least(ratios[1], ratios[2], ratios[3]), 1e-9), pos) = 1),
f AS (SELECT room, unnest(ratios) AS ratio FROM b), s AS (SELECT room, median(ratio) AS scale FROM f GROUP BY 1), d AS (SELECT room, scale, avg(abs(ratio - scale)) / scale AS spread FROM f JOIN s USING (room) GROUP BY room, scale)
SELECT room, n, round(scale, 6) AS scale, round(spread, 6) AS spread, n >= 2 AND spread <= 0.15 AS accepted FROM d JOIN (SELECT room, count(*) AS n FROM b GROUP BY 1) USING (room)""",
    "published_scenes": f"{_views} SELECT sample_id || '.json' AS path, count(*)::INT AS n, count(*)::INT AS attributes FROM gt GROUP BY sample_id",
    "seam_pieces": """WITH p AS (SELECT DISTINCT user_id AS mask, event_id % 16 AS row, (event_id * 7 + user_id) % 48 + CASE WHEN user_id % 3 = 0 THEN 16 ELSE 0 END AS col FROM events),
q AS (SELECT * FROM p WHERE NOT (mask % 4 = 1 AND col BETWEEN 10 AND 20) AND NOT (mask % 4 = 2 AND col BETWEEN 1 AND 30)),
m AS (SELECT mask, bool_or(col = 0) AND bool_or(col = 47) AS seam, bool_or(col = 24) AND bool_or(col = 23) AS turned FROM q GROUP BY 1),
g AS (SELECT mask, col + 1 AS start, lead(col, 1, 48) OVER (PARTITION BY mask ORDER BY col) - col - 1 AS length FROM (SELECT mask, col FROM q UNION SELECT mask, -1 FROM m)),
w AS (SELECT mask, arg_min(start, (-length, start)) AS start, max(length) AS length FROM g GROUP BY 1),
f AS (SELECT mask, (seam AND NOT turned)::INT AS frame, CASE WHEN seam AND turned AND length > 0 THEN start + length // 2 END AS cut FROM m JOIN w USING (mask)),
c AS (SELECT mask, frame, CASE WHEN col >= cut THEN 1 ELSE 0 END AS piece, row, CASE WHEN frame = 1 THEN (col + 24) % 48 ELSE col END AS c FROM q JOIN f USING (mask))
SELECT mask, frame, piece, min(c) AS x, min(row) AS y, max(c) - min(c) + 1 AS w, max(row) - min(row) + 1 AS h, count(*) AS area FROM c GROUP BY ALL""",
    "corner_pixels": f"""{_SIDES}, q AS (SELECT s.sample_id, e, z, sqrt(dx * dx + dy * dy) AS d, (atan2(dx, dy) / (2 * pi()) + 0.5::DOUBLE - floor(atan2(dx, dy) / (2 * pi()) + 0.5::DOUBLE)) * {WIDTH} - 0.5::DOUBLE AS x FROM side s JOIN scene USING (sample_id)),
f AS (SELECT sample_id, arg_min(e, (x, e)) AS first, count(*) AS held FROM q GROUP BY 1)
SELECT sample_id, ((e - first + held) % held)::INT AS n, round(x, 6) AS x, round((0.5::DOUBLE - atan2(z / 2, d) / pi()) * {HEIGHT} - 0.5::DOUBLE, 6) AS ceiling_y, round((0.5::DOUBLE - atan2(-z / 2, d) / pi()) * {HEIGHT} - 0.5::DOUBLE, 6) AS floor_y FROM q JOIN f USING (sample_id)""",
    "camera_faults": f"""{_views}, c AS (SELECT sample_id, x, y, CASE sample_id % 7 WHEN 1 THEN 0 WHEN 2 THEN x * 0.75::DOUBLE WHEN 3 THEN x / 2 WHEN 5 THEN 2 * x WHEN 6 THEN x * 0.75::DOUBLE ELSE x / 4 END AS px, CASE sample_id % 7 WHEN 1 THEN 0 WHEN 2 THEN y * 0.75::DOUBLE WHEN 3 THEN y * 0.75::DOUBLE ELSE y / 4 END AS py,
  sample_id % 7 IN (4, 5) AS high FROM scene WHERE has_gt)
SELECT sample_id, concat_ws(',', CASE WHEN NOT (px > 0 AND px < x AND py > 0 AND py < y AND (px < x / 2 OR py < y / 2)) THEN 'outside' END, CASE WHEN high THEN 'height' END) AS faults FROM c""",
    "layout_targets": f"""{_TARGETS} SELECT sample_id, k::INT AS col, round(met, 6) AS ranges, round(-atan2(z / 2, met), 6) AS ceiling, round(atan2(z / 2, met), 6) AS floor, round(0.96::DOUBLE ** away, 6) AS corner FROM far JOIN dist USING (sample_id, k) JOIN scene USING (sample_id)""",
    "target_faults": f"{_views} SELECT sample_id, 'ceiling' AS faults FROM scene WHERE has_gt AND sample_id % 13 = 0",
    "image_statistics": """WITH p AS (SELECT user_id AS image, (event_id % 256 + event_id * 3 % 256 + CASE WHEN user_id % 7 = 0 THEN event_id * 3 % 256 ELSE event_id * 5 % 256 END)::DOUBLE / 3 / 255 AS g, value / 10 AS d FROM events),
s AS (SELECT image, avg(g) AS rgb_mean, stddev_pop(g) AS rgb_std, avg((g < 0.025)::INT) AS dark_fraction, avg((g > 0.98)::INT) AS bright_fraction, avg((d > 0 AND d < 1e6)::INT) AS depth_valid_fraction, avg((d > 0 AND d < 0.05::DOUBLE * 3)::INT) AS near_surface_fraction FROM p GROUP BY 1)
SELECT image, round(rgb_mean, 6) AS rgb_mean, round(rgb_std, 6) AS rgb_std, round(dark_fraction, 6) AS dark_fraction, round(bright_fraction, 6) AS bright_fraction, round(depth_valid_fraction, 6) AS depth_valid_fraction, round(near_surface_fraction, 6) AS near_surface_fraction,
  concat_ws(',', CASE WHEN dark_fraction > 0.8 THEN 'mostly_dark' END, CASE WHEN bright_fraction > 0.8 THEN 'mostly_clipped' END, CASE WHEN rgb_std < 0.02 THEN 'almost_uniform_rgb' END, CASE WHEN depth_valid_fraction < 0.95 THEN 'missing_depth' END, CASE WHEN near_surface_fraction > 0.2 THEN 'near_surface_dominates' END) AS flags FROM s""",
    "id_differences": """SELECT id, CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'repeated' END AS fault FROM (SELECT coalesce(o_custkey, c_custkey) AS id, n, c_custkey FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1)
  FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey) WHERE n IS NULL OR c_custkey IS NULL OR n > 1""",
    "split_differences": f"{_views}, c AS (SELECT * FROM room WHERE room_id LIKE '%7' AND split <> 'test') SELECT room_id, 'test' AS split, 'found' AS side FROM c UNION ALL SELECT room_id, split, 'expected' FROM c",
    "exclusion_plan": """SELECT c_nationkey || '/' || c_custkey AS room_id, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey::VARCHAR END AS house_id, CASE WHEN c_custkey % 3 <> 0 THEN 'r' || c_custkey % 5 END AS reason
FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_id % 7 <> 0 GROUP BY 1 HAVING count(DISTINCT event_id) >= 4)""",
    "room_review": """SELECT o_orderkey AS room_id, CASE WHEN o_orderkey % 29 = 0 THEN 'geometry: open' WHEN o_orderkey % 11 < 5 THEN 'scale: contour ratio' WHEN o_orderkey % 400 NOT BETWEEN 1 AND 199 THEN 'scale: area' WHEN o_orderkey % 37 NOT BETWEEN 1 AND 29 THEN 'scale: extent'
  WHEN o_orderkey % 7 = 0 THEN 'no single scale' WHEN o_orderkey % 31 = 0 THEN 'cameras: none' END AS exclusion FROM orders""",
    "scene_faults": f"""{_views}, o AS (SELECT sample_id, bool_or(label = 'N' OR l_partkey % 17 = 0) AS bad FROM line WHERE label <> 'N' OR l_suppkey % 10 = 0 GROUP BY 1), s AS (SELECT * FROM scene JOIN o USING (sample_id) WHERE has_gt)
SELECT sample_id, 'image size' AS fault FROM s WHERE sample_id % 19 = 0 UNION ALL SELECT sample_id, 'layout' FROM s WHERE sample_id % 21 = 0 UNION ALL SELECT sample_id, 'object' FROM s WHERE bad""",
    "audit_flags": f"{_AUDIT} SELECT room_id, array_to_string(flags, ',') AS flags, geometry_pass FROM a",
    "flag_counts": f"{_AUDIT} SELECT flag, count(*) AS rooms FROM (SELECT unnest(flags) AS flag FROM a) GROUP BY 1",
    "review_order": f"{_AUDIT} SELECT room_id, geometry_pass FROM a ORDER BY geometry_pass, over DESC, ceil DESC, fill, room_id LIMIT 100",
    "vertical_hits": f"""{_views}, {_TRI}, p AS (SELECT sample_id, x / 4 + 0.0131592653::DOUBLE AS x, y / 4 + 0.0071828182::DOUBLE AS y FROM scene WHERE has_gt),
q AS (SELECT sample_id, z1, x - x0 AS dx, y - y0 AS dy, b_x - x0 AS ux, b_y - y0 AS uy, b_z - z1 AS uz, cx - x0 AS vx, cy - y0 AS vy, cz - z1 AS vz FROM p JOIN t USING (sample_id)),
h AS (SELECT *, (dx * vy - dy * vx) / (ux * vy - uy * vx) AS s, (ux * dy - uy * dx) / (ux * vy - uy * vx) AS w FROM q WHERE abs(ux * vy - uy * vx) > 1e-12)
SELECT sample_id, count(*) AS hits, round(min(z1 + s * uz + w * vz), 6) AS low, round(max(z1 + s * uz + w * vz), 6) AS high FROM h WHERE s >= -1e-8 AND w >= -1e-8 AND s + w <= 1 + 1e-8 GROUP BY 1""",
    "level_planes": f"""WITH RECURSIVE {VIEW_SQL}, {_TRI}, n AS (SELECT sample_id, (z1 + b_z + cz) / 3 AS z, (b_y - y0) * (cz - z1) - (b_z - z1) * (cy - y0) AS nx, (b_z - z1) * (cx - x0) - (b_x - x0) * (cz - z1) AS ny, (b_x - x0) * (cy - y0) - (b_y - y0) * (cx - x0) AS nz FROM t),
l AS (SELECT sample_id, z, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area FROM n WHERE sqrt(nx * nx + ny * ny + nz * nz) > 1e-12 AND nz >= 0.95 * sqrt(nx * nx + ny * ny + nz * nz)),
o AS (SELECT sample_id, z, row_number() OVER (PARTITION BY sample_id ORDER BY z) AS k FROM (SELECT DISTINCT sample_id, z FROM l)),
c AS (SELECT sample_id, z, k, z AS head FROM o WHERE k = 1 UNION ALL SELECT o.sample_id, o.z, o.k, CASE WHEN o.z - c.head > 0.25 THEN o.z ELSE c.head END FROM c JOIN o ON o.sample_id = c.sample_id AND o.k = c.k + 1)
SELECT sample_id, round(sum(z * area) / sum(area), 6) AS z, round(sum(area), 6) AS area, count(*) AS n FROM l JOIN c USING (sample_id, z) GROUP BY sample_id, head""",
    "furniture_anchor": f"{_views} SELECT sample_id, round(median((x0 + x1) / 2), 6) AS x, round(median((y0 + y1) / 2), 6) AS y, round(greatest(median(greatest(x1 - x0, y1 - y0)), greatest(max((x0 + x1) / 2) - min((x0 + x1) / 2), max((y0 + y1) / 2) - min((y0 + y1) / 2)) / 2, 0.2), 6) AS reach FROM gt GROUP BY 1",
    "farthest_object": f"{_views} SELECT sample_id AS room_id, round(max(sqrt(((x0 + x1) / 2) ** 2 + ((y0 + y1) / 2) ** 2 + ((z0 + z1) / 2) ** 2)), 6) AS distance FROM gt GROUP BY 1",
    "distinct_candidates": "SELECT user_id AS room, round((event_id % 5)::DOUBLE / 10, 3) AS x, round((event_id % 3)::DOUBLE / 10, 3) AS y, max(value) AS clearance FROM events WHERE value >= 0 GROUP BY ALL",
    "local_densities": f"""WITH {_POINT}, d AS (SELECT a.id, a.i, b.i AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d FROM p a JOIN p b USING (id)),
own AS (SELECT id, i, min(d) AS own FROM d WHERE i <> j GROUP BY ALL), near AS (SELECT id, i, j FROM d QUALIFY row_number() OVER (PARTITION BY id, i ORDER BY d, j) <= 5),
q AS (SELECT n.id, n.i, max(own) AS m FROM near n JOIN own o ON o.id = n.id AND o.i = n.j GROUP BY ALL) SELECT id AS obj_id, round(sum(m), 6) AS total, round(max(m), 6) AS top FROM q GROUP BY 1""",
    "structural_files": """SELECT f AS file, f IN ('floor.glb', 'wall.glb', 'ceil', 'others.obj') AS structural, count(*) AS n FROM (SELECT ['floor.glb', 'wall.glb', 'floor_lamp.glb', 'ceil', 'others.obj', 'architecture.v2.glb', 'chair.glb'][l_linenumber % 7 + 1] AS f FROM lineitem) GROUP BY ALL""",
    "room_list": "SELECT DISTINCT l_orderkey::VARCHAR AS room_id FROM lineitem WHERE l_orderkey % 9 <> 0",
    "paired_corners": f"{_views}, {_RING}, k AS (SELECT sample_id, px, py, row_number() OVER (PARTITION BY sample_id ORDER BY px, e) - 1 AS k FROM ring) SELECT sample_id, (2 * k)::INT AS n, px::DOUBLE AS x, py::DOUBLE AS y FROM k UNION ALL SELECT sample_id, (2 * k + 1)::INT, px, py + 5 FROM k",
    "half_extent_boxes": f"""{_views}, q AS (SELECT *, radians(sample_id % 12 * 15) AS t, CASE WHEN l_partkey % 11 = 0 OR l_partkey % 13 = 0 THEN 0 ELSE x1 - x0 END AS sx, y1 - y0 AS sy FROM line), r AS (SELECT *, abs(sx * cos(t)) / 2 + abs(sy * sin(t)) / 2 AS hx, abs(sx * sin(t)) / 2 + abs(sy * cos(t)) / 2 AS hy FROM q)
SELECT sample_id, obj_idx, round(x0 - hx, 6) + 0::DOUBLE AS x0, round(y0 - hy, 6) + 0::DOUBLE AS y0, round(z0 - (z1 - z0) / 2, 6) + 0::DOUBLE AS z0, round(x0 + hx, 6) AS x1, round(y0 + hy, 6) AS y1, round(z0 + (z1 - z0) / 2, 6) AS z1 FROM r""",
    "resolved_scale": f"{_views} SELECT sample_id AS room_id, round(CASE WHEN sample_id % 3 = 0 THEN 1 + sample_id % 4 ELSE 2.6::DOUBLE / z END, 6) AS scale, CASE WHEN sample_id % 3 = 0 THEN 'table' ELSE 'ceiling' END AS scale_source FROM scene WHERE has_gt",
    "plausible_rooms": """SELECT o_orderkey AS room_id, concat_ws(',', CASE WHEN o_orderkey % 19 < 5 THEN 'contour ratio' END, CASE WHEN o_orderkey % 400 NOT BETWEEN 1 AND 199 THEN 'area' END, CASE WHEN o_orderkey % 37 NOT BETWEEN 1 AND 29 THEN 'extent' END) AS reject,
  CASE WHEN o_orderkey % 19 > 15 THEN 'contour ratio' ELSE '' END AS review FROM orders""",
    "mean_sizes": "WITH m AS (SELECT l_partkey % 10 AS class, avg(l_quantity) AS size FROM lineitem WHERE l_partkey % 10 < 7 GROUP BY 1) SELECT c.class, round(coalesce(size, (SELECT avg(size) FROM m)), 6) AS size FROM (SELECT DISTINCT p_partkey % 10 AS class FROM part) c LEFT JOIN m USING (class)",
    "spread_sample": "SELECT house, room FROM (SELECT o_custkey AS house, o_orderkey AS room, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE k = 1 OR k = n // 2 + 1 OR k = n",
    "padded_boxes": """WITH b AS (SELECT *, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, l_quantity AS w, 1 + l_quantity / 2 AS h FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, greatest(round_even(x - w * 0.25, 0), 0)::INT AS x0, greatest(round_even(y - h * 0.25, 0), 0)::INT AS y0, least(round_even(x + w + w * 0.25, 0), 90)::INT AS x1, least(round_even(y + h + h * 0.25, 0), 60)::INT AS y1 FROM b""",
    "annotation_faults": """WITH q AS (SELECT user_id AS mask, count(*) AS n, sum((value > 50)::INT) AS held FROM events GROUP BY 1), b AS (SELECT *, CASE WHEN mask % 7 = 0 THEN 1 ELSE n END + CASE WHEN mask % 3 = 2 THEN n ELSE 0 END AS w, held + (mask % 5 = 0)::INT AS area FROM q)
SELECT mask, concat_ws(',', CASE WHEN w > n THEN 'box' END, CASE WHEN mask % 3 = 1 THEN 'runs' END, CASE WHEN area <> held OR area <= 0 OR area > w THEN 'area' END) AS faults FROM b""",
}
