"""Queries of the choice of cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cameras as C
from .scoring import rounded
from .views import table

VIEWS = 3


def _candidates(spark, sf):
    """A candidate per event of a user; some are on furniture, some have no clearance, some are there twice."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        u.alias("room"), (e * 7 % 31 / 10).alias("x"), (e * 11 % 29 / 10).alias("y"), (1 + e % 2 / 10).alias("z"), F.when(e % 17 == 0, float("nan")).otherwise((F.col("value") / 1000)).alias("clearance"),
        ((u % 4 == 0) & (e % 50 != 0) | (e % 3 == 0)).alias("on_furniture"),
    )


def chosen_views(spark, sf):
    rooms = table(spark, sf, "events").select(F.col("user_id").alias("room")).distinct().withColumn("min_clearance", C.least_clearance(1.5 + F.col("room") % 4))
    chosen = C.chosen_views(_candidates(spark, sf), rooms, "room", VIEWS, relaxed=True)
    out = chosen.select("room", "fault", "fell_back", "below_clearance", F.posexplode_outer("cameras").alias("n", "c")).select("room", "fault", "fell_back", "below_clearance", "n", "c.*")
    return rounded(out, "x", "y", "z", "clearance")


QUERIES = {"chosen_views": chosen_views}

_far = lambda *taken: "least(" + ", ".join(f"sqrt((p.x - {t}.x) ** 2 + (p.y - {t}.y) ** 2)" for t in taken) + ")"
_next = lambda name, *taken: f"""{name} AS (SELECT p.* FROM pool p {" ".join(f"JOIN {t} ON {t}.room = p.room AND {t}.k <> p.k" for t in taken)}
  QUALIFY row_number() OVER (PARTITION BY p.room ORDER BY {_far(*taken)} DESC, p.clearance DESC, p.k) = 1)"""  # noqa: E731

ORACLE_SQL = {
    "chosen_views": f"""WITH c AS (SELECT user_id AS room, (event_id * 7 % 31)::DOUBLE / 10 AS x, (event_id * 11 % 29)::DOUBLE / 10 AS y, 1 + (event_id % 2)::DOUBLE / 10 AS z, value / 1000 AS clearance,
  event_id % 17 <> 0 AS fit, (user_id % 4 = 0 AND event_id % 50 <> 0) OR event_id % 3 = 0 AS furniture FROM events),
u AS (SELECT *, count(*) FILTER (NOT furniture) OVER (PARTITION BY room) AS free FROM c), used AS (SELECT * FROM u WHERE NOT furniture OR free < {VIEWS}),
fell AS (SELECT room, bool_or(furniture) AS fell_back FROM used GROUP BY 1), d AS (SELECT room, x, y, z, max(clearance) AS clearance FROM used WHERE fit AND clearance >= 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY clearance DESC, x, y, z) AS k, least(0.1::DOUBLE, (1.5::DOUBLE + room % 4) * 0.04::DOUBLE) AS need FROM d),
s AS (SELECT room, count(*) FILTER (clearance >= need) AS enough FROM r GROUP BY 1), pool AS (SELECT r.* FROM r JOIN s USING (room) WHERE clearance >= need OR k <= {VIEWS}),
a AS (SELECT * FROM pool WHERE k = 1), {_next("b", "a")}, {_next("e", "a", "b")}, t AS (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM e), q AS (SELECT room, count(*) AS held FROM pool GROUP BY 1)
SELECT o.room, CASE WHEN coalesce(held, 0) < {VIEWS} THEN 'too few poses' END AS fault, coalesce(fell_back, false) AS fell_back, coalesce(held, 0) >= {VIEWS} AND enough < {VIEWS} AS below_clearance, n::INT AS n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(clearance, 6) AS clearance
FROM (SELECT DISTINCT room FROM c) o LEFT JOIN fell USING (room) LEFT JOIN s USING (room) LEFT JOIN q USING (room) LEFT JOIN t ON t.room = o.room AND held >= {VIEWS}""",
}
