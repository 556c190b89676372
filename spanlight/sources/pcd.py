"""Point files in ASCII PCD: a header of eleven lines, then a line of x, y, z for each point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .las import BLOCK, saved

# Fixed values of the format.
HEADER = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA ascii\n"


def write_pcd(df: DataFrame, path: str) -> None:
    """x, y, z in files of up to BLOCK points, named by partition and block."""

    def run(batches):
        block = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lines = "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in zip(*(c.to_pylist() for c in part.columns)))
                yield saved((HEADER.format(n=part.num_rows) + lines).encode(), block, path, "pcd")
                block += 1

    files = df.select("x", "y", "z").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").mapInArrow(run, "bytes long")
    files.write.format("noop").mode("overwrite").save()


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of all .pcd files; header lines are those that don't start with a number."""
    lines = spark.read.option("pathGlobFilter", "*.pcd").text(path).where(F.col("value").rlike(r"^-?[0-9.]"))
    v = F.split("value", " ")
    return lines.select(*[v[i].cast("double").alias(c) for i, c in enumerate("xyz")])
