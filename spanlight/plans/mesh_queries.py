"""Queries of clipped meshes: a fan of triangles from the origin to two places of each embedding, cut by the planes of boxes."""

from pyspark.sql import functions as F

from ..operators import meshes as m
from .aggregate_queries import TRI
from .registry import query

LOW, HIGH = (-0.04, -0.1, -0.05), (0.1, 0.06, 0.12)
PLANES = m.box_planes(LOW, HIGH)


def _sql(planes):
    parts = ["r0 AS (SELECT vec_id, [[0.0, 0.0, 0.0], [ax, ay, az], [bx, by_, bz]] AS r FROM t)"]
    for i, (a, b, c, d) in enumerate(planes):
        h = lambda v: f"({v}[1] * {a} + {v}[2] * {b} + {v}[3] * {c} - {d})"
        parts.append(f"e{i} AS (SELECT vec_id, k, r[k] AS u, r[k % len(r) + 1] AS v FROM (SELECT vec_id, r, unnest(range(1, len(r) + 1)) AS k FROM r{i})), "
                     f"h{i} AS (SELECT vec_id, k, u, v, {h('u')} AS hu, {h('v')} AS hv FROM e{i}), "
                     f"o{i} AS (SELECT vec_id, 2 * k AS k, u AS q FROM h{i} WHERE hu >= 0 UNION ALL SELECT vec_id, 2 * k + 1, [u[1] + (v[1] - u[1]) * hu / (hu - hv), u[2] + (v[2] - u[2]) * hu / (hu - hv), u[3] + (v[3] - u[3]) * hu / (hu - hv)] FROM h{i} WHERE hu * hv < 0), "
                     f"r{i + 1} AS (SELECT vec_id, list(q ORDER BY k) AS r FROM o{i} GROUP BY vec_id)")  # fmt: skip
    last = f"r{len(planes)}"
    x = "(p[2]-o[2])*(q[3]-o[3])-(p[3]-o[3])*(q[2]-o[2])", "(p[3]-o[3])*(q[1]-o[1])-(p[1]-o[1])*(q[3]-o[3])", "(p[1]-o[1])*(q[2]-o[2])-(p[2]-o[2])*(q[1]-o[1])"
    parts.append(f"f AS (SELECT vec_id, r[1] AS o, r[k] AS p, r[k + 1] AS q, len(r) AS n FROM (SELECT vec_id, r, unnest(range(2, len(r))) AS k FROM {last}))")
    parts.append("g AS (SELECT vec_id, any_value(n) AS corners, sum(sqrt((" + ")**2 + (".join(x) + ")**2) / 2) AS area FROM f GROUP BY vec_id)")
    return f"WITH {TRI}, " + ", ".join(parts) + " SELECT vec_id, CAST(coalesce(corners, 0) AS INT) AS corners, round(coalesce(area, 0), 8) AS area FROM t LEFT JOIN g USING (vec_id)"


def _rings(spark, sf):
    v = [F.col("embedding")[i].cast("double") for i in range(6)]
    at = F.array(m.corner(F.lit(0.0), F.lit(0.0), F.lit(0.0)), m.corner(*v[:3]), m.corner(*v[3:]))
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", at.alias("ring"))


@query("g11_clipped_mesh", _sql(PLANES))
def g11_clipped_mesh(spark, sf):
    """Corners and area of what a box leaves of each triangle."""
    cut = _rings(spark, sf).withColumn("ring", m.cut(F.col("ring"), PLANES))
    n = F.when(F.size("ring") > 2, F.size("ring")).otherwise(F.lit(0))
    return cut.select("vec_id", n.alias("corners"), F.round(m.area(F.col("ring")), 8).alias("area"))
