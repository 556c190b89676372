"""Point relations over the driver's tables: a corridor cloud from line items, a small 3-D cloud from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns that identify a point together.
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

GROUND, LOW_VEGETATION, TOWER, WIRE, BUILDING, HIGH_VEGETATION = 1, 2, 3, 4, 6, 15

_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_extendedprice/100.0D AS x", "CAST(l_partkey % 1000 AS DOUBLE) AS y", "l_quantity*2.0D AS z",
    "CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN 1 WHEN l_returnflag='A' THEN 2 WHEN l_returnflag='N' AND l_linestatus='F' THEN 3 WHEN l_returnflag='N' THEN 4 WHEN l_linestatus='F' THEN 15 ELSE 6 END AS seg_type",
    "CAST(l_partkey % 256 AS INT) AS r", "CAST(l_orderkey % 256 AS INT) AS g", "CAST(l_suppkey % 256 AS INT) AS b", "CAST(l_suppkey AS INT) AS cluster_id", "l_linenumber <> 7 AS display_enable",
)

#: The same relation in SQL, as a common table expression p.
P = "p AS (SELECT " + ", ".join(_COLUMNS).replace("0D", "0::DOUBLE") + " FROM lineitem)"
#: The embeddings' first three components as a cloud, as a common table expression e.
E = "e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def points(spark: SparkSession, sf_dir: str, x_between: tuple[float, float] | None = None) -> DataFrame:
    """All points; with a range of x those within it, asked of the stored column too, so that the scan skips by its statistics."""
    stored = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if x_between is None:
        return stored.selectExpr(*_COLUMNS)
    low, high = x_between
    return stored.where(f"l_extendedprice BETWEEN {low * 100 - 1!r}D AND {high * 100 + 1!r}D").selectExpr(*_COLUMNS).where(f"x BETWEEN {low!r}D AND {high!r}D")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", "label", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y", "CAST(embedding[2] AS DOUBLE) AS z")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem*.parquet").selectExpr(*_COLUMNS)
