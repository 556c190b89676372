"""Side files of a project: class maps, tile trees and cluster catalogues in XML, roads as text geometry, tables as text, options in INI."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    """Columns whose names start with _ become attributes."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """seg_type, target of the entries <Item Type= To=>; of several for a class the least target."""
    items = read_xml(spark, path, "Item", "_Type int, _To int")
    return items.groupBy(F.col("_Type").alias("seg_type")).agg(F.min("_To").alias("target"))


def project_tiles(spark: SparkSession, path: str) -> DataFrame:
    """tx, ty, level, file, n of the nodes of a project tree."""
    nodes = read_xml(spark, path, "Node", "_tx long, _ty long, _level int, _file string, _n long")
    return nodes.select(*[F.col(f"_{c}").alias(c) for c in ("tx", "ty", "level", "file", "n")])


def cluster_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, kind, tile: a row for each tile that a cluster's text names, separated by semicolons."""
    clusters = read_xml(spark, path, "Cluster", "_ClassifyType int, _Id int, _VALUE string")
    tile = F.explode(F.filter(F.split(F.trim("_VALUE"), ";"), lambda x: x != "")).alias("tile")
    return clusters.select(F.col("_Id").alias("cluster_id"), F.col("_ClassifyType").alias("kind"), tile)


def write_roads(roads: DataFrame, path: str) -> None:
    """roads with id and vertices (array of x, y) -> lines of an id, a tab and a LINESTRING."""
    text = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("vertices", lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))), ", "), F.lit(")"))
    roads.select(F.concat_ws("\t", F.col("id").cast("string"), text).alias("value")).write.text(path)


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """id, vertices, and the box x1, y1, x2, y2; a line that is no LINESTRING has no vertices."""
    line = spark.read.text(path).select(F.split("value", "\t", 2).alias("v")).select(F.col("v")[0].cast("long").alias("id"), F.regexp_extract(F.col("v")[1], r"^LINESTRING \((.*)\)$", 1).alias("text"))
    pair = F.transform(F.filter(F.split("text", ",\\s*"), lambda p: p != ""), lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))
    roads = line.select("id", pair.alias("vertices"))
    xs, ys = F.col("vertices.x"), F.col("vertices.y")
    return roads.select("id", "vertices", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def road_segments(roads: DataFrame) -> DataFrame:
    """id, x1, y1, x2, y2 of consecutive vertices."""
    n = F.size("vertices")
    pair = F.explode(F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at("vertices", i).alias("a"), F.element_at("vertices", i + 1).alias("b"))))).alias("s")
    return roads.select("id", pair).select("id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_tiles(df: DataFrame, path: str, size: float) -> None:
    """Points below tx=, ty= folders."""
    df.withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size)).repartition("tx", "ty").write.partitionBy("tx", "ty").parquet(path)


def tile_paths(spark: SparkSession, path: str) -> DataFrame:
    """tx, ty, folder, n: which folder holds a tile's points, and how many."""
    rows = spark.read.parquet(path).select("tx", "ty", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("tx", "ty").agg(F.min(F.regexp_extract("file", r"(tx=[^/]+/ty=[^/]+)/[^/]+$", 1)).alias("folder"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Options:
    """Options of the segmentation, as the [Options] section of an INI file has them; unknown keys are left out."""

    cell: float = 5.0
    low_height: float = 20.0
    high_height: float = 50.0
    ground_slope: float = 1.0
    keep_noise: bool = True
    kinds: str = "ground,vegetation"

    @classmethod
    def read(cls, text: str) -> Options:
        parser = configparser.ConfigParser(interpolation=None)
        parser.read_string(text)
        given = parser["Options"] if parser.has_section("Options") else {}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        as_bool = lambda v: v.strip().lower() in ("1", "true", "yes", "on")
        return cls(**{k: as_bool(v) if kinds[k] is bool else kinds[k](v) for k, v in given.items() if k in kinds})
