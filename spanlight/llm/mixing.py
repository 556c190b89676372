"""Mixing sources to target weights under a curriculum that changes over the course of training.

Each source's weight is a linear schedule over training time t in [0, 1]. The schedule is integrated in closed form; a
document's place in its source's cumulative token demand is inverted through that integral to a training position, and
documents are range-sorted by position.

Prefix sums over a source are taken in two levels (a hash bucket's sum, then places within the bucket), so a source that
holds most rows is spread over ``BUCKETS`` tasks.

Defined results: a null text has no words; a null source is a source of its own, ordered last; an empty table gives an
empty result; repeated rows count as often as they occur; rows equal in doc_id and size share their places in any order,
which yields the same rows; extra columns of the input pass through where they don't clash with the added ones, which
replace clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import WORD, table

#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: (weight at the start, weight at the end) of the training run, relative to a source's mean weight, repeating.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUDGET = 1.5
MOST_REPEATS = 2.0
#: First hex digits of the order key that make a bucket of a source.
BUCKET_DIGITS = 3
ADDED = ("size", "source_size", "target", "taken", "position")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size -> also rank, target. Shares of ``budget`` times all sizes by weight, where no target exceeds
    ``most`` times its source's size and what is cut off is reshared by weight: sources are sorted by the level at which
    they are full, and the first level that no later source exceeds is the common one. One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    full_order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, everything = full_order.rowsBetween(Window.unboundedPreceding, -1), full_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("place", F.row_number().over(full_order))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("place"))).over(everything)
    s = s.withColumn("first", first).withColumn("common", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything))
    return s.select("source", "source_size", "rank", F.when(F.col("place") < F.col("first"), F.col("cap")).otherwise(F.col("common") * F.col("w")).alias("target"))


def training_time(share: Column, start: Column, end: Column) -> Column:
    """t at which a source with a linear schedule has spent ``share`` of its tokens: the integral of the schedule, inverted."""
    tilt = (end - start) / (end + start)
    root = (F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt)
    return F.when(tilt == 0, share).otherwise(root)


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, schedules=SCHEDULES, budget: float = BUDGET, most: float = MOST_REPEATS) -> DataFrame:
    """docs with doc_id and source -> the same rows with ``ADDED``: words taken from each (repeats counted) and the position
    in training of its first word, range-sorted by position. size: words of a document, by default counted in text."""
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(*kept, (word_count() if size is None else size).alias("_mix_size"), key.alias("_mix_key")).withColumn("_mix_bucket", F.substring("_mix_key", 1, BUCKET_DIGITS))

    sums = sized.groupBy("source", "_mix_bucket").agg(F.sum("_mix_size").alias("in_bucket"))
    aims = targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, budget, most)
    earlier = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    starts = starts.alias("b").join(aims.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("b.source").alias("_mix_source"), F.col("_mix_bucket").alias("_mix_of"), F.col("start").alias("_mix_start"), F.col("t.source_size").alias("_mix_total"), F.col("target").alias("_mix_target"), F.col("rank").alias("_mix_rank"))

    placed = sized.join(starts, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bucket") == F.col("_mix_of")))
    inside = Window.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, total, end, ratio = F.col("_mix_size"), F.col("_mix_total"), F.col("_mix_end"), F.col("_mix_ratio")
    placed = placed.withColumn("_mix_end", F.col("_mix_start") + F.sum("_mix_size").over(inside)).withColumn("_mix_ratio", F.when(total > 0, F.col("_mix_target") / total).otherwise(F.lit(0.0)))
    taken = F.least(F.floor(ratio * end) - F.floor(ratio * (end - n)), F.floor(n * F.lit(most))).cast("long")
    share = F.when(total > 0, (end - n) / total).otherwise(F.lit(0.0))
    of = lambda k: F.element_at(F.array(*[F.lit(float(x[k])) for x in schedules]), F.col("_mix_rank") % len(schedules) + 1)
    out = placed.select(*kept, n.alias("size"), total.alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"), training_time(share, of(0), of(1)).alias("position"))
    return out.orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, in the order of training, with the columns of ``docs``: a document comes as often as its whole
    copies fit into ``taken``, and once more for a share of documents, by a hash of doc_id, as large as what is left over."""
    mixed = mix(docs)
    size, taken = F.col("size"), F.col("taken")
    luck = F.conv(F.substring(F.md5(F.concat(F.lit("copy"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    copies = F.when(size > 0, F.floor(taken / size) + F.when((taken % size) / size > luck, 1).otherwise(0)).otherwise(0).cast("int")
    return mixed.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("words"))
    return mix(docs, size=F.col("words")).select("doc_id", *ADDED)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
c AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap FROM s),
o AS (
  SELECT *, row_number() OVER f AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM c WINDOW f AS (ORDER BY cap / w, rank)),
p AS (SELECT min(place) AS first FROM o WHERE level * w <= cap),
t AS (
  SELECT source, source_size, rank,
         CASE WHEN place < first THEN cap ELSE (SELECT level FROM o WHERE place = (SELECT first FROM p)) * w END AS target
  FROM o, p),
e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(stop - size AS DOUBLE) / source_size ELSE 0 END AS share,
         CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt FROM e)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(ratio * stop) - floor(ratio * (stop - size)), floor(size * 2.0)) AS BIGINT) AS taken,
       CASE WHEN tilt = 0 THEN share
            ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt) END AS position
FROM g
"""
