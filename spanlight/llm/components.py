"""Connected components of a graph of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .frames import Stage


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """edges (u, v) -> (u, v) with v the least id that u reaches, for all u but those least ids."""
    return graph.stars(edges, lambda df, i: stage.write(df, f"{name}-{i}"), lambda i: stage.drop(f"{name}-{i}"))
