"""Shapes as fields: which cells of a grid a mesh fills, how far each is from its surface, samples and surfaces of that.

Meshes (vertices, faces) are worked on with numpy, many small grids at once; Spark spreads meshes. The grid is a cube from -HALF to HALF.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: half the grid's edge, cells of a field, cells of its coarse copy, samples, their spread about the surface
HALF, CELLS, COARSE, SAMPLES, SPREAD = 0.7, 128, 32, 100_000, 0.02
# numbers held at once: points on triangles, cells of all meshes that are filled together
POINTS, TOGETHER = 1 << 17, 1 << 21


def surface_cells(t: np.ndarray, cells: int, half: float = HALF) -> np.ndarray:
    """Cells that triangles (n, 3, 3) pass through, by points on them at most half a cell apart."""
    return surfaces(t, np.zeros(len(t), int), 1, cells, half)[..., 0]


def surfaces(t: np.ndarray, mesh: np.ndarray, count: int, cells: int, half: float = HALF) -> np.ndarray:
    """As surface_cells, of many meshes at once, along the last axis; mesh: the number of each triangle's."""
    cell = 2 * half / cells
    u, v = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    size = np.linalg.norm(np.cross(u, v), axis=1) / 2
    longest = np.maximum(np.maximum(np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)), np.linalg.norm(u - v, axis=1))
    steps = np.maximum(2, np.ceil(np.maximum(np.sqrt(4 * size), longest) / (cell / 2)).astype(int) + 1)
    held = np.zeros((cells,) * 3 + (count,), bool)
    flat = held.reshape(-1)
    for n in np.unique(steps):
        i, j = np.triu_indices(n + 1)
        along, across = i / n, (j - i) / n
        own = np.flatnonzero(steps == n)
        for k in range(0, len(own), max(1, POINTS // len(along))):
            at = own[k : k + max(1, POINTS // len(along))]
            place, fit = 0, True
            for d in range(3):
                c = np.floor((t[at, None, 0, d] + along * u[at, None, d] + across * v[at, None, d] + half) / cell)
                fit = fit & (c >= 0) & (c < cells)
                place = place * cells + c
            flat[((place * count) + mesh[at, None])[fit].astype(np.int64)] = True
    return held


def _spread(x: np.ndarray, join: np.ufunc) -> np.ndarray:
    """Each cell joined with its 26 neighbours; outside nothing is set. Axes behind the third are other shells."""
    for axis in range(3):
        wide = np.pad(x, [(1, 1) if a == axis else (0, 0) for a in range(x.ndim)])
        part = [wide.take(range(k, k + x.shape[axis]), axis) for k in range(3)]
        x = join(join(part[0], part[1]), part[2])
    return x


def filled(shell: np.ndarray, seal: bool = True) -> np.ndarray:
    """The shell with gaps of a cell closed, and what cannot be reached from the border through faces of cells. Axes behind the third are other shells."""
    wall = _spread(_spread(shell, np.logical_or), np.logical_and) | shell if seal else shell
    outside, before = np.zeros_like(wall), -1
    for axis in range(3):
        for end in (0, -1):
            at = tuple(end if a == axis else slice(None) for a in range(3))
            outside[at] = ~wall[at]
    while before != (before := int(outside.sum())):
        for axis in range(3):
            o, w = np.moveaxis(outside, axis, 0), np.moveaxis(wall, axis, 0)
            for k in range(1, len(o)):
                o[k] |= o[k - 1] & ~w[k]
            for k in range(len(o) - 2, -1, -1):
                o[k] |= o[k + 1] & ~w[k]
    return ~outside


def squared_distance(shell: np.ndarray) -> np.ndarray:
    """From each cell's centre to that of the nearest cell of the shell, in cells, squared; axis after axis."""
    d = np.where(shell, 0.0, np.inf)
    for axis in range(3):
        f = np.moveaxis(d, axis, 0)
        best = f.copy()
        for k in range(1, len(f)):
            if k * k >= best.max():
                break
            np.minimum(best[k:], f[:-k] + k * k, out=best[k:])
            np.minimum(best[:-k], f[k:] + k * k, out=best[:-k])
        d = np.moveaxis(best, 0, axis)
    return d


def signed_field(triangles: np.ndarray, cells: int = CELLS, half: float = HALF) -> np.ndarray:
    """Distance to the surface, below 0 inside, of each cell."""
    shell = surface_cells(triangles, cells, half)
    away = np.sqrt(squared_distance(shell)) * (2 * half / cells)
    return np.where(filled(shell), -away, away).astype(np.float32)


def field_at(field: np.ndarray, points: np.ndarray, half: float = HALF) -> np.ndarray:
    """The field between its values, which stand on a grid from -half to half; outside that of the nearest point."""
    n = len(field)
    at = np.clip((points + half) / (2 * half) * (n - 1), 0, n - 1)
    low = np.minimum(at.astype(int), n - 2)
    part = at - low
    out = np.zeros(len(points))
    for corner in np.ndindex(2, 2, 2):
        weight = np.prod(np.where(np.array(corner), part, 1 - part), axis=1)
        out += weight * field[tuple((low + corner).T)]
    return out


def coarse(field: np.ndarray, cells: int = COARSE, half: float = HALF) -> np.ndarray:
    axis = np.linspace(-half, half, cells)
    return field_at(field, np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1).reshape(-1, 3), half).reshape((cells,) * 3).astype(np.float32)


def surface_samples(triangles: np.ndarray, field: np.ndarray, count: int = SAMPLES, seed: int = 0, spread: float = SPREAD, half: float = HALF) -> np.ndarray:
    """x, y, z, side (-1 inside, 1 outside) of points spread about the surface, by numpy's generator."""
    draw = np.random.default_rng(seed)
    size = np.linalg.norm(np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]), axis=1) / 2
    if not size.sum() > 0:
        raise ValueError("a mesh has no surface")
    t = triangles[draw.choice(len(triangles), size=count, p=size / size.sum())]
    r, s = draw.random((2, count, 1))
    far = np.sqrt(r)
    p = t[:, 0] * (1 - far) + t[:, 1] * (far * (1 - s)) + t[:, 2] * (far * s)
    p = np.clip(p + draw.normal(scale=spread, size=p.shape), -half, half)
    return np.column_stack([p, np.where(field_at(field, p, half) < 0, -1.0, 1.0)]).astype(np.float32)


def even_samples(field: np.ndarray, count: int = SAMPLES, seed: int = 1, half: float = HALF) -> np.ndarray:
    """x, y, z, distance of points anywhere in the grid."""
    p = np.random.default_rng(seed).uniform(-half, half, size=(count, 3))
    return np.column_stack([p, field_at(field, p, half)]).astype(np.float32)


def surface_of(field: np.ndarray, half: float = HALF) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and faces of the level 0: each cube of eight values is six tetrahedra about a diagonal, each cut where its edges change sign.

    A tetrahedron with one value, or three, below 0 gives a triangle, with two a quadrangle; faces turn outwards. Edges are shared,
    so the surface is closed where it does not meet the border.
    """
    n = len(field)
    f = field.ravel().astype(float)
    f[f == 0] = 1e-12
    step = np.array([n * n, n, 1])
    base = np.ravel_multi_index(np.indices((n - 1,) * 3).reshape(3, -1), (n,) * 3)
    ways = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    edges, corners = [], []
    for way in ways:
        path = np.concatenate([[0], np.cumsum(step[list(way)])])
        tets = base[:, None] + path
        inside = f[tets] < 0
        for count in (1, 2, 3):
            own = inside.sum(axis=1) == count
            if own.any():
                order = np.argsort(~inside[own], axis=1, kind="stable")
                t = np.take_along_axis(tets[own], order, axis=1)
                pairs = {1: [(0, 1), (0, 2), (0, 3)], 3: [(0, 3), (1, 3), (2, 3)], 2: [(0, 2), (0, 3), (1, 3), (1, 2)]}[count]
                cut = np.stack([np.sort(t[:, list(p)], axis=1) for p in pairs], axis=1)
                for tri in ([(0, 1, 2)] if count != 2 else [(0, 1, 2), (0, 2, 3)]):
                    edges.append(cut[:, list(tri)])
                    corners.append(t[:, 0])
    if not edges:
        return np.zeros((0, 3)), np.zeros((0, 3), np.int32)
    every = np.concatenate(edges)
    kept, faces = np.unique(every.reshape(-1, 2), axis=0, return_inverse=True)
    a, b = kept.T
    share = f[a] / (f[a] - f[b])
    place = lambda k: np.stack(np.unravel_index(k, (n,) * 3), axis=1) / (n - 1) * 2 * half - half
    points = place(a) + share[:, None] * (place(b) - place(a))
    faces = faces.reshape(-1, 3)
    p = points[faces]
    facing = (np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) * (p[:, 0] - place(np.concatenate(corners)))).sum(axis=1)  # from a point inside
    faces[facing < 0] = faces[facing < 0][:, ::-1]
    return points, faces.astype(np.int32)


def grid_bytes(grid: np.ndarray, half: float = HALF) -> bytes:
    """A grid as three sizes, the matrix that puts points on it, and its values."""
    n = len(grid)
    matrix = np.diag([(n - 1) / (2 * half)] * 3 + [1.0])
    matrix[:3, 3] = (n - 1) / 2
    return struct.pack("<3i", *grid.shape) + matrix.astype("<f4").tobytes() + grid.astype("<f4").tobytes()


def shape_fields(meshes: DataFrame, key: str = "path", cells: int = CELLS, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """key, filled, surface (cells), centre (distance there), grid, near, even (files' bytes, null if samples is 0) of each mesh (key, vertices, faces).

    The points are to lie in a cube of edge 1 about the origin, as packed shapes do. A mesh without a surface has no field: nulls.
    """
    kind, types = meshes.schema[key].dataType.simpleString(), [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    away = ((np.indices((cells,) * 3) - cells // 2) ** 2).sum(axis=0).astype(float)[..., None]  # of each cell from the middle one, squared

    def read(column: pa.Array, k: int, kind: type) -> np.ndarray:
        v = column[k]
        return v.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype(kind) if v.is_valid else np.zeros((0, 3), kind)

    def together(triangles: list[np.ndarray]) -> Iterator[tuple]:
        shells = surfaces(np.concatenate(triangles), np.repeat(np.arange(len(triangles)), [len(t) for t in triangles]), len(triangles), cells)
        solids = filled(shells)
        counts = [x.sum(axis=(0, 1, 2)) for x in (solids, shells)]
        near = np.sqrt(np.where(shells, away, np.inf).min(axis=(0, 1, 2))) * (2 * HALF / cells)
        centre = np.where(solids[(cells // 2,) * 3], -near, near).astype(np.float32)
        for k, t in enumerate(triangles):
            files = (None,) * 3
            if samples:
                far = np.sqrt(squared_distance(shells[..., k])) * (2 * HALF / cells)
                field = np.where(solids[..., k], -far, far).astype(np.float32)
                files = (grid_bytes(coarse(field)), surface_samples(t, field, samples, seed).tobytes(), even_samples(field, samples, seed + 1).tobytes())
            yield int(counts[0][k]), int(counts[1][k]), float(centre[k]), *files

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, TOGETHER // cells**3)
        for batch in batches:
            for at in range(0, len(batch), some):
                part = batch.slice(at, some)
                meshes = [read(part.column(1), k, float)[read(part.column(2), k, int)] for k in range(len(part))]
                fit = [len(t) > 0 and bool(np.isfinite(t).all()) for t in meshes]
                found = together([t for t, f in zip(meshes, fit) if f]) if any(fit) else iter(())
                out = [next(found) if f else (None,) * 6 for f in fit]
                columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "filled", "surface", "centre", "grid", "near", "even"])

    spread = meshes.select(key, "vertices", "faces").repartition(int(meshes.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes are much work
    return spread.mapInArrow(rows, f"{key} {kind}, filled long, surface long, centre double, grid binary, near binary, even binary")
