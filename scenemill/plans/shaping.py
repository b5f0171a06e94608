"""The query of shape fields: a box for each part, whose cells its SQL counts by its edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields as D
from .scoring import rounded
from .views import table

GRID = 24
_EDGES = ("0.2 + (p_partkey % 13) / 20.0", "0.2 + (p_partkey % 7) / 10.0", "0.2 + (p_size % 11) / 20.0")


def box_fields(spark, sf):
    """Cells that a part's box fills, those of its surface, and the distance to it in the middle of the grid."""
    half = [F.expr(f"cast({e} as double)") / 2 + 0.0031 for e in _EDGES]
    corner = lambda i, j, k: F.array(half[0] * i, half[1] * j, half[2] * k)
    ends = (-1, 1)
    vertices = F.array(*[corner(i, j, k) for i in ends for j in ends for k in ends])
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    faces = F.array(*[F.array(*map(F.lit, t)) for a, b, c, d in quads for t in ((a, b, c), (a, c, d))])
    meshes = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), vertices.alias("vertices"), faces.alias("faces"))
    return rounded(D.shape_fields(meshes, "part", GRID, samples=0).select("part", "filled", "surface", "centre"), "centre")


QUERIES = {"box_fields": box_fields}

_CELL = f"({2 * D.HALF} / {GRID})::DOUBLE"
_low, _high = [[f"floor(({s}h{i} + {D.HALF}) / {_CELL})::BIGINT" for i in range(3)] for s in ("-", "")]

ORACLE_SQL = {
    "box_fields": f"""WITH e AS (SELECT p_partkey AS part, {", ".join(f"(({e})::DOUBLE / 2 + 0.0031::DOUBLE) AS h{i}" for i, e in enumerate(_EDGES))} FROM part),
c AS (SELECT part, {", ".join(f"{a} AS a{i}, {b} AS b{i}" for i, (a, b) in enumerate(zip(_low, _high)))} FROM e), n AS (SELECT *, {", ".join(f"b{i} - a{i} + 1 AS n{i}" for i in range(3))} FROM c)
SELECT part, n0 * n1 * n2 AS filled, n0 * n1 * n2 - greatest(n0 - 2, 0) * greatest(n1 - 2, 0) * greatest(n2 - 2, 0) AS surface,
  round(-least({", ".join(f"{GRID // 2} - a{i}, b{i} - {GRID // 2}" for i in range(3))}) * {_CELL}, 6) + 0::DOUBLE AS centre FROM n""",
}
