"""Cases of the fourth round of findings: ties, and work that grew faster than its input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.functions import polygons, regions as R
from scenemill.operators import cameras as C, fields as D, footprints as O, panoramas as P, planes as L, scenes as S


def test_equal_ways_go_by_clearance(spark):
    """Both others are 2.64... away; a hypotenuse worked out another way is a last digit longer for one of them."""
    rows = [("a", 2.0, 2.7, 1.1, 0.33496, False), ("a", 0.9, 0.3, 1.0, 0.11199, False), ("a", 0.4, 0.6, 1.0, 0.1832, False)]
    candidates = spark.createDataFrame(rows, "room string, x double, y double, z double, clearance double, on_furniture boolean")
    rooms = spark.createDataFrame([("a", 0.1)], "room string, min_clearance double")
    cameras = C.chosen_views(candidates, rooms, "room", 2).first().cameras
    assert [(c.x, c.y) for c in cameras] == [(2.0, 2.7), (0.4, 0.6)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def crowded(spark, n):
    """Upright boxes of a scene, and a layout."""
    draw = random.Random(4)
    boxes = [([draw.random() * 30 for _ in range(3)], [draw.random() * 2 for _ in range(3)]) for _ in range(n)]
    flat = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    kind = "sample_id long, obj_idx int, object_id string, box struct<center:array<double>,size:array<double>,basis:array<array<double>>>"
    objects = spark.createDataFrame([(1, k, str(k), (c, s, flat)) for k, (c, s) in enumerate(boxes)] + [(2, 0, "x", None), (2, 1, "y", None)], kind)
    layouts = spark.createDataFrame([(1, [[0.0, 0.0], [30.0, 0.0], [30.0, 30.0], [0.0, 30.0]], 0.0, 30.0), (2, None, 0.0, 2.0), (3, [], 0.0, 1.0)], "sample_id long, ring array<array<double>>, floor_z double, ceiling_z double")
    return boxes, objects, layouts


def test_relations_of_a_crowded_scene_are_compared_as_arrays(spark):
    boxes, objects, layouts = crowded(spark, 1200)
    found = S.relations(objects, layouts)
    assert "MapInArrow" in plan(found) and "lambda" not in plan(found)  # no pair is a row, and no corner a lambda's
    got = {(int(r.source), int(r.target)) for r in found.where("relation_type = 'touching'").collect()}
    c, s = (np.array(x) for x in zip(*boxes))
    far = np.abs(c[:, None] - c[None])
    i, j = np.nonzero((far < (s[:, None] + s[None] + 0.2) / 2).all(axis=2))
    assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_relation_counts_of_a_crowded_scene(spark):
    boxes, objects, layouts = crowded(spark, 300)
    found = S.relations(objects, layouts).groupBy("relation_type").count()
    assert "lambda" not in plan(found)
    got = {r.relation_type: r["count"] for r in found.collect()}
    low, high = [np.array([c[2] + d * (s[2] + 0.1) / 2 for c, s in boxes]) for d in (-1, 1)]
    assert got["touching_floor"] == (low < 0.075).sum() and got["touching_ceiling"] == (high > 29.925).sum()


def plain_targets(ring, camera, low, high, width):
    """Ranges, ceiling, floor and corner of one room, a ray at a time."""
    def nearest(ux, uy):
        met = []
        for (x, y), (p, q) in zip(ring, ring[1:] + ring[:1]):
            ex, ey, dx, dy = p - x, q - y, x - camera[0], y - camera[1]
            cross = ux * ey - uy * ex
            if abs(cross) > 1e-10 and (dx * ey - dy * ex) / cross > P.NEAR and -P.NEAR <= (dx * uy - dy * ux) / cross <= 1 + P.NEAR:
                met.append((dx * ey - dy * ex) / cross)
        return min(met, default=None)

    turns = [((i + 0.5) / width - 0.5) * 2 * np.pi for i in range(width)]
    ranges = [nearest(np.sin(t), np.cos(t)) for t in turns]
    seen = []
    for x, y in ring:
        dx, dy = x - camera[0], y - camera[1]
        far = np.hypot(dx, dy)
        met = nearest(dx / far, dy / far) if far else None
        if met is not None and abs(met - far) <= max(far * 1e-5, 1e-6):
            seen.append((np.arctan2(dx, dy) / (2 * np.pi) + 0.5) % 1 * width - 0.5)
    apart = [min((min(abs(i - x), width - abs(i - x)) for x in seen), default=None) for i in range(width)]
    angle = lambda h, r: None if r is None else np.arctan2(h, r)
    return ranges, [angle(camera[2] - high, r) for r in ranges], [angle(camera[2] - low, r) for r in ranges], [None if a is None else P.FADE**a for a in apart]


def targets(spark, width):
    ell = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 4.0], [0.0, 4.0]]
    rooms = [(0, ell, [1.0, 1.5, 1.0], 0.0, 2.5), (1, ell[:3], [3.0, 0.5, 3.0], 0.0, 2.5), (2, ell, [9.0, 9.0, 1.0], 0.0, 2.5), (3, [], [1.0, 1.0, 1.0], 0.0, 2.0), (4, None, [1.0, 1.0, 1.0], 0.0, 2.0), (5, ell, None, 0.0, 2.0)]
    df = spark.createDataFrame(rooms, "k int, ring array<array<double>>, camera array<double>, floor_z double, ceiling_z double")
    return rooms, P.layout_targets(df.coalesce(1), width)


def test_targets_equal_one_ray_at_a_time(spark):
    rooms, found = targets(spark, 16)
    got = {r.k: r for r in found.collect()}
    for k, ring, camera, low, high in rooms:
        want = plain_targets(ring, camera, low, high, 16) if ring and camera else [[None] * 16] * 4
        for name, numbers in zip(("ranges", "ceiling", "floor", "corner"), want):
            assert [None if v is None else round(v, 9) for v in getattr(got[k], name)] == [None if v is None else round(v, 9) for v in numbers], (k, name)
    assert "lambda" not in plan(found)


def test_targets_of_one_small_file_are_dealt_over_all_partitions(spark):
    _, found = targets(spark, 16)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def bricks(n):
    """Vertices and faces of boxes, some beyond the grid, some flat."""
    draw = np.random.default_rng(2)
    corner = np.array([[i, j, k] for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)], float)
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    faces = [list(t) for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    sizes = draw.uniform(0.02, 0.6, (n, 3)) * np.where(np.arange(n) % 9 == 0, 2, 1)[:, None]
    return [((corner * s + draw.uniform(-0.1, 0.1, 3)).tolist(), faces) for s in sizes]


def test_fields_of_many_meshes_equal_those_of_each(spark):
    meshes = bricks(40)
    rows = [(k, v, f) for k, (v, f) in enumerate(meshes)] + [(98, [], []), (99, None, None)]
    found = D.shape_fields(spark.createDataFrame(rows, "path int, vertices array<array<double>>, faces array<array<int>>").coalesce(1), cells=24, samples=0)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one small file is dealt over all
    got = {r.path: r for r in found.collect()}
    for k, (v, f) in enumerate(meshes):
        t = np.array(v)[np.array(f)]
        shell, field = D.surface_cells(t, 24), D.signed_field(t, 24)
        assert (got[k].filled, got[k].surface, got[k].centre) == (int(D.filled(shell).sum()), int(shell.sum()), float(field[12, 12, 12])), k
    assert got[98].filled is None and got[99].filled is None


def triangle_groups(n):
    """Edges of triangles in groups: anywhere, on a coarse grid, halves of rectangles, of two operands; one group is large."""
    draw = np.random.default_rng(5)
    edges, groups = [], []
    for k in range(n):
        m = 300 if k == 7 else draw.integers(1, 7)
        t = draw.uniform(0, 10, (m, 3, 2))
        if k == 7:
            t = draw.uniform(0, 10, (m, 1, 2)) + draw.uniform(0, 0.5, (m, 3, 2))
        elif k % 4 == 1:
            t = np.round(t * 2) / 2
        elif k % 4 > 1:
            low, size = np.round(draw.uniform(0, 4, (m, 2)), 1), np.round(draw.uniform(0.5, 3, (m, 2)), 2)
            a, b, c, d = low, low + size * [1, 0], low + size, low + size * [0, 1]
            t = np.concatenate([np.stack([a, b, c], axis=1), np.stack([a, c, d], axis=1)])
        e = R.triangle_edges(t)
        e[len(e) // 6 * 3 :, 4] = k % 3 == 0
        edges.append(e)
        groups.append(np.full(len(e), k))
    return edges, groups


@pytest.mark.parametrize("rule", [R.UNION, R.SHARED])
def test_overlays_of_many_groups_equal_those_of_each(rule):
    edges, groups = triangle_groups(48)
    mixed = np.random.default_rng(1).permutation(sum(map(len, edges)))
    found = R.overlays(np.concatenate(edges)[mixed], np.concatenate(groups)[mixed], 50, rule)
    ends, areas = np.cumsum(found.sizes), found.areas()
    for k, e in enumerate(edges):
        want = R.overlay(e, rule)
        own = np.flatnonzero(found.group == k)
        sizes = lambda parts: sorted(round(sum(p), 9) for p in parts)
        assert sizes([areas[own][found.part[own] == p] for p in set(found.part[own])]) == sizes([map(R.ring_area, p) for p in want]), k
        corners = {tuple(np.round(x, 9)) for i in own for x in found.points[ends[i] - found.sizes[i] : ends[i]]}
        assert corners == {tuple(np.round(x, 9)) for p in want for r in p for x in r}, k


def test_groups_of_footprints_may_reach_over_batches(spark):
    """Rows of 40 squares that touch, in more triangles than are put together at once."""
    n = O.TOGETHER // 80 + 30
    at = "array(cast(id as double), 0.0, 0.0), array(id + 1.0, 0.0, 0.0), array(id + 1.0, 1.0, 0.0), array(cast(id as double), 1.0, 0.0)"
    square = spark.range(n * 40).select(F.floor(F.col("id") / 40).alias("k"), F.expr(f"array({at})").alias("p"))
    halves = [square.select("k", *[F.col("p")[i].alias(c) for c, i in zip("abc", corners)]) for corners in ((0, 1, 2), (0, 2, 3))]
    got = O.footprints(halves[0].unionByName(halves[1]), ["k"], rectangles=False).collect()
    assert sorted((r.k, round(r.area, 6), len(r.rings[0])) for r in got) == [(k, 40.0, 4) for k in range(n)]


def test_first_values_of_clusters_equal_one_at_a_time():
    draw = np.random.default_rng(3)
    lengths = [1, 2, 500, 3, 40, 1]
    starts = np.cumsum([0, *lengths[:-1]])
    v = np.concatenate([np.sort(draw.uniform(0, 5, n)) for n in lengths])
    gap = np.repeat([0.5, 0.1, 0.02, 9.0, 0.3, 0.1], lengths)
    for held in (None, v[0] - 0.2, v[0] - 0.9):
        want, first = [], None
        for k, x in enumerate(v):
            first = (x if held is None or k else held) if k in starts else first
            first = x if x - first > gap[k] else first
            want.append(first)
        assert L.first_values(v, gap, starts, held).tolist() == want


def test_distance_to_areas_needs_no_lambda(spark):
    hole = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [1.0, 3.0], [3.0, 3.0], [3.0, 1.0]]]
    points = [(0.5, 0.5, 0.0), (2.0, 2.5, 0.5), (7.0, 8.0, 5.0), (4.0, 2.0, 0.0), (None, 1.0, None)]
    df = spark.createDataFrame([(hole, x, y, want) for x, y, want in points] + [([], 1.0, 1.0, None)], "rings array<array<array<double>>>, x double, y double, want double")
    found = df.select(R.area_distance(F.col("rings"), F.col("x"), F.col("y")).alias("d"), "want")
    assert "lambda" not in plan(found)
    assert all((r.d is None and r.want is None) or r.d == pytest.approx(r.want) for r in found.collect())


def test_turned_boxes_overlap_without_lambdas(spark):
    kind = "struct<center:array<double>,size:array<double>,basis:array<array<double>>>"
    c = 0.5**0.5
    flat, turned = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[c, c, 0.0], [-c, c, 0.0], [0.0, 0.0, 1.0]]
    cube = ([0.0, 0.0, 0.0], [2.0, 2.0, 2.0], flat)
    rows = [(cube, ([1.0, 0.0, 1.0], [2.0, 2.0, 2.0], flat), 2.0), (cube, ([0.0, 0.0, 0.0], [2.0, 2.0, 2.0], turned), None), (cube, ([9.0, 0.0, 0.0], [2.0, 2.0, 2.0], turned), 0.0), (cube, None, None)]
    df = spark.createDataFrame(rows[:1] + rows[2:], f"a {kind}, b {kind}, want double")
    found = polygons.oriented_overlap(df, "a", "b")
    assert "lambda" not in plan(found)
    assert [r.overlap for r in found.collect()] == [2.0, 0.0, None]
    octagon = polygons.oriented_overlap(spark.createDataFrame(rows[1:2], f"a {kind}, b {kind}, want double"), "a", "b").first().overlap
    assert octagon == pytest.approx(16 * (2**0.5 - 1))


def test_sorted_tables_hold_what_is_kept(spark):
    from scenemill.operators import ranking

    df = spark.range(100).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("v"), F.lit("long").alias("more"))
    held = ranking.in_order(df, ["g"], [F.col("v")], keep=["g"])
    assert held.columns == ["g", "_part", "_at"] and [r.g for r in held.orderBy("_at").collect()] == sorted(k % 3 for k in range(100))


def test_turned_boxes_are_matched_without_lambdas(spark):
    from scenemill.operators import matching
    from scenemill.plans import turning

    box = "struct<x0:double,y0:double,z0:double,x1:double,y1:double,z1:double>"
    rows = [(3, 0, "x", 0.9, (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)), (3, 1, "x", 0.8, (5.0, 0.0, 0.0, 6.0, 1.0, 1.0)), (3, 2, "x", 0.7, None)]
    boxes = spark.createDataFrame(rows, f"sample_id long, obj_idx int, label string, score double, box {box}")
    turned = boxes.withColumn("box", turning._turned(F.col("box")))
    found = matching.greedy_match(turned, turned.drop("score"), ["sample_id", "label"], 0.5)
    assert "_form" in plan(found)  # corners are worked out in the Arrow function
    assert sorted((r.obj_idx, r.gt_idx, round(r.iou, 9)) for r in found.collect()) == [(0, 0, 1.0), (1, 1, 1.0), (2, None, 0.0)]


def test_shapes_that_are_named_score_as_their_clouds(spark):
    from scenemill.operators import scene_metrics as M

    box = "struct<x0:double,y0:double,z0:double,x1:double,y1:double,z1:double>"
    rows = [(s, k, "x", 0.9 - k / 10, (3.0 * k, 0.0, 0.0, 3.0 * k + 1, 1.0, 1.0)) for s in range(4) for k in range(3)]
    boxes = spark.createDataFrame(rows, f"sample_id long, obj_idx int, label string, score double, box {box}")
    draw = np.random.default_rng(1)
    shapes = spark.createDataFrame([(k, draw.random((5, 3)).tolist()) for k in range(4)] + [(4, [])], "shape long, cloud array<array<double>>")
    names = [boxes.select("sample_id", "obj_idx", F.expr(f"cast((sample_id + obj_idx * 2 + {d}) % 6 as bigint)").alias("shape")) for d in (0, 1)]
    whole = M.shape_scores(boxes, boxes.drop("score"), *[n.join(shapes, "shape").select("sample_id", "obj_idx", "cloud") for n in names])
    found = M.shape_scores(boxes, boxes.drop("score"), *names, shapes=shapes)
    sorted_rows = lambda df: sorted((r.sample_id, round(r.chamfer, 9), round(r.fscore, 9)) for r in df.collect())
    assert sorted_rows(found) == sorted_rows(whole) and len(sorted_rows(found)) > 2
