"""Whitening of embeddings: a distributed centred covariance, its leading components, a broadcast projection.

Entries become integers first (``floor(64 c) + 1000000``), so counts and sums are exact. The fit list holds each distinct vector
once, so a vector that a third of the rows repeat weighs as one. Tasks hand on one partial sum each (d numbers, then d
rows of d), never rows; the driver gets a d x d matrix, whatever the number of rows, and solves it in ``eigen``.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped. Vectors of another length than most
rows have (the longer of equally frequent ones) are dropped too, as they share no covariance; empty vectors likewise. Entries
beyond 2^45 count as 2^45. Components without variance (eigenvalue up to 1e-12 of the trace) aren't returned, as nothing
can be scaled to one there; so equal vectors alone, or an empty table, give an empty result. ``deviation`` is null where it
passes 63 bits. Repeated rows each get their result. Columns named as the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import eigen
from .frames import Stage, table

COMPONENTS = 16
SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 45)
#: Share of the trace up to which an eigenvalue counts as none.
NOTHING = 1e-12
_CHUNK = 4096


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S; eigenvalues and unit eigenvectors (columns) of their covariance, its trace, and the largest
    absolute entry of the whitened vectors' covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part of the mean goes exactly, before anything is rounded."""
        return centred(x, self.n, self.sums)

    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integers(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector counts, with ``_x``, the vector as array<long>."""
    entry = F.col(vector)
    usable = entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    near = lambda c: F.least(F.greatest(c.cast("double") * F.lit(float(SCALE)), F.lit(-MOST)), F.lit(MOST))
    return df.where(usable).withColumn("_x", F.transform(entry, lambda c: F.floor(near(c)).cast("long") + F.lit(SHIFT).cast("long")))


def usual_length(rows: DataFrame) -> int | None:
    found = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return found and found["d"]


def summed(fit: DataFrame, d: int, make, width: int) -> np.ndarray:
    """The sum of make(x) over all chunks x of the fit list, a (rows, width) matrix: a partial sum a task, added in Spark."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = make(matrix(batch.column(0).slice(at, _CHUNK), d))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = fit.select("_x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max((r["i"] for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and their sums by dimension, as integers."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                x = matrix(batch.column(0).slice(at, _CHUNK), d)
                n, total = n + len(x), total + x.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(v) for v in total])], names=["i", "n", "s"])

    rows = fit.select("_x").mapInArrow(run, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).orderBy("i").collect()
    return (rows[0]["n"], tuple(int(r["s"]) for r in rows)) if rows else (0, ())


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """rows with _x of length d -> the model, None where nothing varies."""
    stage = Stage(rows.sparkSession, "whitening")
    vectors = stage.write(rows.select("_x").distinct(), "fit")
    n, sums = exact_sums(vectors, d)
    model = None
    if n:

        def products(x):
            y = centred(x, n, sums)
            return y.T @ y

        covariance = summed(vectors, d, products, d) / n
        covariance, trace = (covariance + covariance.T) / 2, float(np.trace(covariance))
        values, found = eigen.leading(covariance, components)
        some = values > NOTHING * trace
        if some.any():
            model = Whitening(n, sums, values[some], found[:, some], trace)
            weights = model.projection()

            def whitened_products(x):
                z = centred(x, n, sums) @ weights
                return z.T @ z

            k = weights.shape[1]
            error = float(np.abs(summed(vectors, d, whitened_products, k) / n - np.eye(k)).max())
            model = Whitening(n, sums, model.values, model.vectors, trace, error)
    stage.drop("fit")
    return model


def transformed(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """rows with _x -> the same with ``deviation`` (of the row from the mean, n times, squared and summed, exact) and ``whitened``."""
    keep = [c for c in rows.columns if c.lower() not in ("_x", "deviation", "whitened")]
    n, sums, weights = model.n, model.sums, model.projection()
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]

    def deviations(x: np.ndarray) -> pa.Array:
        away = x - whole
        if float(np.abs(away).max(initial=0) + 1) * n < float(1 << 62) ** 0.5 / d:  # so squares and their sum fit
            return pa.array(((n * away - np.array(rest, np.int64)) ** 2).sum(1), pa.int64())
        exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in away.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                x = matrix(part.column(len(keep)), d)
                z = centred(x, n, sums) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [deviations(x), lists], names=[*keep, "deviation", "whitened"])

    schema = T.StructType(rows.select(*keep).schema.fields + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.select(*keep, "_x").mapInArrow(run, schema)


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """df -> its usable rows with ``deviation`` and ``whitened`` (array, a number for each component), and the model."""
    rows = integers(df, vector)
    d = usual_length(rows)
    rows = rows.where(F.size("_x") == (d or 0))
    model = d and fit(rows, d, components)
    if not model:
        return df.drop("deviation", "whitened").limit(0).withColumns({"deviation": F.lit(0).cast("long"), "whitened": F.array(F.lit(0.0))}), None
    return transformed(rows, d, model), model


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    n, trace, error = (model.n, model.trace, model.identity_error) if model else (0, 1.0, 0.0)
    explained = F.array(*[F.lit(float(v / trace)) for v in (model.values if model else [0.0])])
    rows = out.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
