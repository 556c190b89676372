"""Queries of line segments in rasters."""

from pyspark.sql import functions as F

from ..operators import lines
from ..sources.points import P, points
from .registry import query

B = "b AS (SELECT cx + i AS cx, cy + j AS cy, sum(value * CASE i WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END * CASE j WHEN 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS value FROM m, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) GROUP BY 1, 2)"


def _tops(spark, sf):
    """Cells of 5 m with their highest point, in parts of 128."""
    p = points(spark, sf)
    return p.groupBy(F.floor(F.col("x") / 5.0).alias("cx"), F.floor(F.col("y") / 5.0).alias("cy")).agg((F.max("z") / 128.0).alias("value"))


@query("r6_level_lines", f"""WITH {P}, m AS (SELECT CAST(floor(x / 5.0) AS BIGINT) AS cx, CAST(floor(y / 5.0) AS BIGINT) AS cy, max(z) / 128.0::DOUBLE AS value FROM p GROUP BY 1, 2), {B},
 g AS (SELECT cx - i AS cx, cy - j AS cy, sum(CASE i WHEN 1 THEN value ELSE -value END / 2) AS gx, sum(CASE j WHEN 1 THEN value ELSE -value END / 2) AS gy FROM b, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) GROUP BY 1, 2)
 SELECT cx, cy, round(sqrt(gx * gx + gy * gy), 6) AS size, round(gx / sqrt(gx * gx + gy * gy), 6) + 0.0 AS along_sin, round(-gy / sqrt(gx * gx + gy * gy), 6) + 0.0 AS along_cos FROM g WHERE gx <> 0 OR gy <> 0""")
def r6_level_lines(spark, sf):
    """Directions of level lines of the blurred surface; all sums are of whole parts of a power of two, so they are exact."""
    at = lines.level_lines(lines.blurred(_tops(spark, sf)))
    return at.select("cx", "cy", F.round("size", 6).alias("size"), (F.round(F.sin("angle"), 6) + 0.0).alias("along_sin"), (F.round(F.cos("angle"), 6) + 0.0).alias("along_cos"))


@query("r6_line_segments")
def r6_line_segments(spark, sf):
    """Segments in the surface of the highest points; tested on known edges."""
    s = lines.segments(_tops(spark, sf))
    return s.select(*[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2", "width")], "n", "aligned", F.round("strength", 3).alias("strength"))
