"""Fields of shapes against distances known in closed form."""

import numpy as np
import pytest

from scenemill.operators import fields as D


def ball(radius, n=24):
    """Triangles of a sphere."""
    u, v = np.meshgrid(np.linspace(0, np.pi, n + 1), np.linspace(0, 2 * np.pi, 2 * n + 1), indexing="ij")
    p = radius * np.stack([np.sin(u) * np.cos(v), np.sin(u) * np.sin(v), np.cos(u)], axis=-1)
    a, b, c, d = p[:-1, :-1], p[1:, :-1], p[1:, 1:], p[:-1, 1:]
    return np.concatenate([np.stack([a, b, c], axis=2).reshape(-1, 3, 3), np.stack([a, c, d], axis=2).reshape(-1, 3, 3)])


def brick(h):
    c = np.array([[i, j, k] for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)], float) * h
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return c, np.array([t for a, b, c_, d in quads for t in ((a, b, c_), (a, c_, d))])


def centres(n):
    at = (np.arange(n) + 0.5) / n * 2 * D.HALF - D.HALF
    return np.stack(np.meshgrid(at, at, at, indexing="ij"), axis=-1)


def test_field_of_a_ball_is_right_within_a_cell():
    n, r = 40, 0.45
    field = D.signed_field(ball(r), n)
    want = np.linalg.norm(centres(n), axis=-1) - r
    cell = 2 * D.HALF / n
    assert np.abs(np.abs(field) - np.abs(want)).max() < 1.8 * cell
    sure = np.abs(want) > 1.8 * cell
    assert (np.sign(field[sure]) == np.sign(want[sure])).all()
    assert (D.filled(D.surface_cells(ball(r), n)).sum() * cell**3) == pytest.approx(4 / 3 * np.pi * r**3, rel=0.2)


def test_field_of_a_box_is_right_within_a_cell():
    n, h = 32, np.array([0.3, 0.45, 0.2])
    v, f = brick(h)
    q = np.abs(centres(n)) - h
    want = np.linalg.norm(np.maximum(q, 0), axis=-1) + np.minimum(q.max(axis=-1), 0)
    assert np.abs(np.abs(D.signed_field(v[f], n)) - np.abs(want)).max() < 1.8 * 2 * D.HALF / n


def test_squared_distance_equals_all_pairs():
    shell = np.random.default_rng(0).random((9, 9, 9)) < 0.02
    at = np.argwhere(shell)
    every = ((np.indices(shell.shape).reshape(3, -1).T[:, None] - at) ** 2).sum(axis=2).min(axis=1).reshape(shell.shape)
    assert (D.squared_distance(shell) == every).all()
    assert np.isinf(D.squared_distance(np.zeros((4, 4, 4), bool))).all()


def test_a_gap_of_a_cell_is_sealed_and_a_window_is_not():
    shell = np.zeros((20, 20, 20), bool)
    shell[4:16, 4:16, 4:16] = True
    shell[5:15, 5:15, 5:15] = False
    shell[4, 10, 10] = False
    assert D.filled(shell)[10, 10, 10] and D.filled(shell, seal=False).sum() == shell.sum()
    shell[4, 6:14, 6:14] = False
    assert not D.filled(shell)[10, 10, 10]


def test_surface_of_a_field_is_closed_and_faces_outwards():
    n, r = 24, 0.4
    axis = np.linspace(-D.HALF, D.HALF, n)
    field = np.linalg.norm(np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1), axis=-1) - r
    v, f = D.surface_of(field)
    assert np.abs(np.linalg.norm(v, axis=1) - r).max() < 0.005
    t = v[f]
    assert (np.cross(t[:, 0], t[:, 1]) * t[:, 2]).sum() / 6 == pytest.approx(4 / 3 * np.pi * r**3, rel=0.02)
    sides = np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]])
    assert len(np.unique(sides, axis=0)) == len(sides) and {tuple(s) for s in sides} == {tuple(s[::-1]) for s in sides}
    assert len(D.surface_of(np.ones((4, 4, 4)))[1]) == 0


def test_samples_and_files(spark):
    v, f = brick(np.array([0.3, 0.3, 0.3]))
    meshes = spark.createDataFrame([("a", v.tolist(), f.tolist()), ("none", [], [])], "path string, vertices array<array<double>>, faces array<array<int>>")
    got = {r.path: r for r in D.shape_fields(meshes, cells=32, samples=500).collect()}
    near, even = (np.frombuffer(got["a"][c], "<f4").reshape(-1, 4) for c in ("near", "even"))
    assert len(near) == len(even) == 500 and set(near[:, 3]) == {-1.0, 1.0} and np.abs(near[:, :3]).max() < 0.4
    want = np.where((np.abs(even[:, :3]) < 0.3).all(axis=1), -1, 1)
    sure = np.abs(np.abs(even[:, :3]).max(axis=1) - 0.3) > 0.06
    assert (np.sign(even[sure, 3]) == want[sure]).all()
    assert len(got["a"].grid) == 12 + 64 + 4 * 32**3 and np.frombuffer(got["a"].grid[:12], "<i4").tolist() == [32] * 3
    assert got["none"].filled is None and got["none"].grid is None
    assert D.field_at(np.arange(8.0).reshape(2, 2, 2), np.array([[0.0, 0, 0], [9.0, 9, 9]])).tolist() == [3.5, 7.0]
