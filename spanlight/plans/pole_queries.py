"""Queries of poles."""

from pyspark.sql import functions as F

from ..operators import poles
from ..sources.points import KEY, P, points
from .registry import query

STEP, CELL, AREA, FILL, LAYERS = 25.0, 8.0, 640.0, 0.3, 2

TRUNKS = f"""{P}, c AS (SELECT CAST(floor(z / {STEP}) AS BIGINT) AS layer, CAST(floor(x / {CELL}) AS BIGINT) AS cx, CAST(floor(y / {CELL}) AS BIGINT) AS cy, count(*) AS n, sum(x) AS sx, sum(y) AS sy, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2 FROM p WHERE seg_type = 3 GROUP BY 1, 2, 3),
 k AS (SELECT row_number() OVER (ORDER BY layer, cx, cy) AS id, * FROM c), e AS (SELECT a.id AS u, b.id AS v FROM k a JOIN k b ON a.layer = b.layer AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
 w AS (SELECT id, id AS root FROM k UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.id), l AS (SELECT id, min(root) AS piece FROM w GROUP BY id),
 q AS (SELECT piece, layer, count(*) * {CELL * CELL} AS area, sum(sx) / sum(n) AS mx, sum(sy) / sum(n) AS my, sum(n) AS n, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2, min(z1) AS z1, max(z2) AS z2 FROM k JOIN l USING (id) GROUP BY piece, layer),
 s AS (SELECT *, (z1 + z2) / 2 AS mz FROM q WHERE area < {AREA} AND z2 - z1 > {FILL * STEP}),
 f AS (SELECT a.piece AS u, b.piece AS v FROM s a JOIN s b ON abs(a.layer - b.layer) = 1 AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2),
 g AS (SELECT piece, piece AS root FROM s UNION SELECT f.v, g.root FROM g JOIN f ON f.u = g.piece), h AS (SELECT piece, min(root) AS trunk FROM g GROUP BY piece),
 t AS (SELECT trunk, count(DISTINCT layer) AS layers, CAST(sum(n) AS BIGINT) AS n, min(z1) AS z1, max(z2) AS z2, avg(mx) AS mx, avg(my) AS my, covar_pop(mx, mz) / nullif(var_pop(mz), 0) AS lx, covar_pop(my, mz) / nullif(var_pop(mz), 0) AS ly FROM s JOIN h USING (piece) GROUP BY trunk HAVING count(DISTINCT layer) >= {LAYERS})"""


def trunks(spark, sf):
    return poles.trunks(points(spark, sf).where("seg_type = 3"), STEP, CELL, AREA, FILL, LAYERS)


@query("p3c_trunks", f"WITH RECURSIVE {TRUNKS} SELECT layers, n, z1, z2, round(mx, 9) AS mx, round(my, 9) AS my, round(lx / sqrt(lx * lx + ly * ly + 1), 5) AS ux, round(ly / sqrt(lx * lx + ly * ly + 1), 5) AS uy FROM t")
def p3c_trunks(spark, sf):
    """Chains of narrow pieces over adjoining layers among the towers' points, with their axes."""
    return trunks(spark, sf).select("layers", "n", "z1", "z2", *[F.round(c, 9).alias(c) for c in ("mx", "my")], *[F.round(c, 5).alias(c) for c in ("ux", "uy")])


@query("p3c_pole_points")
def p3c_pole_points(spark, sf):
    """Points near a trunk's axis; tested against all pairs."""
    p = points(spark, sf)
    labelled = poles.pole_points(p.select(*KEY, "x", "y", "z"), trunks(spark, sf), 5.0, 2.0).where("trunk IS NOT NULL")
    return labelled.select(*KEY, "x", "y", "z", "trunk")
