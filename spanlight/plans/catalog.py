"""All registered queries."""

from . import aggregate_queries, classify_queries, corridor_queries, filter_queries, fit_queries, function_queries, graph_queries, join_queries, line_queries, mask_queries, mesh_queries, more_queries, pole_queries, polygon_queries, raster_queries, source_queries, terrain_queries, tile_queries, window_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
