"""Queries of further masks: holes, classes, hulls, skeletons."""

from pyspark.sql import functions as F

from ..operators import raster as r
from ..sources.points import P, points
from .graph_queries import CLOSURE_2D
from .raster_queries import DILATE, ERODE, M, mask
from .registry import query

COMPONENTS = "k AS (SELECT row_number() OVER (ORDER BY cx, cy) AS id, cx AS x, cy AS y FROM {0}), " + CLOSURE_2D.format("")


@query("r11_holes", f"WITH RECURSIVE {P}, {M.format('seg_type = 4')}, {DILATE.format('m', 'd')}, {ERODE.format('d', 'ee')}, h AS (SELECT cx, cy FROM ee EXCEPT SELECT cx, cy FROM m), {COMPONENTS.format('h')}, b AS (SELECT component FROM l GROUP BY component HAVING count(*) * 400.0 >= 800) SELECT k.x AS cx, k.y AS cy FROM l JOIN k USING (id) WHERE component IN (SELECT component FROM b)")
def r11(spark, sf):
    return r.holes(mask(spark, sf, "seg_type = 4"), 3, 20.0, 800.0)


@query("r4_wire_mask", f"WITH {P}, {M.format('seg_type = 4').replace('20.0', '5.0')}, {M.format('seg_type = 3').replace('m AS', 'o AS').replace('20.0', '5.0')}, {DILATE.format('m', 'd')}, {ERODE.format('d', 'e')}, {DILATE.format('o', 'w')} SELECT cx, cy FROM e EXCEPT SELECT cx, cy FROM w")
def r4(spark, sf):
    return r.class_mask(points(spark, sf), 5.0, [4], [3])


@query("r4_vegetation_mask", f"WITH {P}, {M.format('seg_type IN (2, 15)')}, {DILATE.format('m', 'd')}, {ERODE.format('d', 'e')} SELECT cx, cy FROM e")
def r4_vegetation(spark, sf):
    return r.class_mask(points(spark, sf), 20.0, [2, 15])


@query("r7_scaled_mask", f"WITH {P}, {M.format('seg_type = 3')} SELECT DISTINCT CAST(floor((cx + 0.5) * 0.4) AS BIGINT) AS cx, CAST(floor((cy + 0.5) * 0.4) AS BIGINT) AS cy FROM m")
def r7_scaled(spark, sf):
    return r.scaled(mask(spark, sf, "seg_type = 3"), 0.4)


@query("r7_hulls")
def r7_hulls(spark, sf):
    """Hulls of the cells of each class; tested against a plain hull."""
    cells = points(spark, sf).select("seg_type", F.floor(F.col("x") / 20.0).alias("cx"), F.floor(F.col("y") / 20.0).alias("cy")).distinct()
    return r.hulls(cells, "seg_type").select("seg_type", F.to_json("ring").alias("ring"))


@query("r7_thinned_mask")
def r7_thinned(spark, sf):
    """Tested against thinning an array."""
    return r.thinned(mask(spark, sf, "seg_type = 3"))


@query("r3_tower_mask")
def r3(spark, sf):
    """Cells of class 3; the parts are tested each."""
    return r.tower_mask(mask(spark, sf, "seg_type = 3"))[0]
