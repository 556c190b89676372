"""Streaming ingestion of points into tiles with levels of detail (an extension: batches of any source, appended exactly once a batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import detail_level


def placed(df: DataFrame, edge: float) -> DataFrame:
    """Points with level and tile: the level by a hash of the place, so it doesn't depend on batches."""
    place = F.pmod(F.xxhash64("x", "y", "z"), F.lit(100))
    level = detail_level(place)
    size = F.lit(float(edge)) * F.pow(F.lit(2.0), level)
    return df.withColumn("level", level).withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size))


def append_tiles(stream: DataFrame, path: str, checkpoint: str, edge: float = 125.0) -> StreamingQuery:
    """Runs until the available input is tiled; a batch that is repeated after a failure replaces its own files."""

    def add(batch: DataFrame, batch_id: int) -> None:
        placed(batch, edge).repartition("level", "tx", "ty").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, length: str, late: str) -> DataFrame:
    """Events per type and window of event time; later ones than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
