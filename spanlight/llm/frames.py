"""Helpers that the operators of this package share: staged tables, and Arrow text columns as numpy byte blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.staging import removed, shared_dir

#: Words of the contracts: maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task handles at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Tables written to the shared folder to cut lineage; ``drop`` frees those that no later step reads. The shuffle files of
    a written table go as soon as it stands."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path, before = f"{self.base}/{name}", self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        removed(self.spark, self.base, *names)


KINDS = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def plus(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema with further fields: name=kind."""
    return T.StructType(schema.fields + [T.StructField(k, KINDS[v]) for k, v in kinds.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column without nulls, and the n + 1 offsets of its values."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values that hold up to ``most`` bytes together, one value at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def map_texts(df: DataFrame, make, added: str, rows: int = 512) -> DataFrame:
    """df with the columns of the DDL ``added``, in place of clashing ones. ``make()`` runs once a task and returns a function from a
    list of texts (None where null) to a list of arrays, one for each added column; it gets up to ``rows`` texts at a time."""
    fields = df.sparkSession.createDataFrame([], added).schema.fields
    names = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in names]
    passed = [c for c in keep if c != "text"] + ["text"]

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = work(part.column(len(passed) - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(passed) - ("text" not in keep))] + found, names=out_names)

    out_names = passed[: len(passed) - ("text" not in keep)] + [f.name for f in fields]
    schema = df.select(*out_names[: len(out_names) - len(fields)]).schema
    for f in fields:
        schema = schema.add(f)
    return df.select(*passed).mapInArrow(run, schema)
