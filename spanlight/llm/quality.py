"""Quality rules whose cutoffs carry a guarantee: few good documents of any stratum, of those that pass the base rule, are rejected by cutoffs.

Each rule rejects documents with a measure above a cutoff. On the labelled documents of a stratum (its language) the
cutoffs of a fixed grid are tested from the loosest to tighter ones; one is certified if the exact (Clopper-Pearson)
upper bound of its false rejection rate is at most ``RISK / rules``, and testing stops at the first that isn't. Testing in a
fixed order needs no correction within a rule; over strata and rules ``DELTA`` is divided by their number (Bonferroni). So with
probability 1 - DELTA no stratum loses more than ``RISK`` of its good documents to all rules together. Of the
certified cutoffs the one with the best balance of bad less good documents rejected is taken, the loosest of equals.
A stratum with too few labels to certify anything rejects nothing beyond the base rule: with ``RISK / rules`` = 1 % and 20 tests it takes about 600 good
labels of which none is lost. What the base rule rejects is outside of the guarantee.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is one of its own; null
labels are left out, a document labelled twice takes its lowest label; empty tables give empty results; repeated rows are judged
each; added columns replace clashing ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import Stage, map_texts, table

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
MIN_WORDS, REPEAT_PERCENT = 50, 50
RISK, DELTA, STEP = 0.05, 0.05, 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: measure: parts per thousand of a count in another.
MEASURES = {"symbols": ("n_symbols", "word_chars"), "marks": ("n_marks", "word_chars"), "upper": ("n_upper", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}


def repeated_words(words: list) -> int:
    """Words in windows of three that occur twice or more, each word once."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice[1:] |= (first := twice.copy())[:-1]
    twice[2:] |= first[:-2]
    return int(twice.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(text) - len(text.translate(NO_UPPER)) if not text.isascii() else sum(map(text.count, UPPER)), text.count("!"),
    )


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_UPPER = dict.fromkeys(map(ord, UPPER))


def measured(docs: DataFrame) -> DataFrame:
    """docs with text -> also ``COUNTS``."""

    def make():
        return lambda texts: [pa.array(x, pa.int64()) for x in (zip(*map(counts_of, texts)) if texts else [[]] * len(COUNTS))]

    return map_texts(docs, make, ", ".join(f"{c} long" for c in COUNTS))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def measure(name: str):
    part, of = MEASURES[name]
    return F.floor(F.col(part) * 1000 / F.greatest(F.col(of), F.lit(1)))


def at_most(k: int, n: int, p: float) -> float:
    """Probability of k or fewer of n, each with probability p."""
    term = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return math.fsum(map(math.exp, term))


def cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> dict:
    """{(stratum, measure): cutoff} from counts with doc_id and labels with quality. Only histograms of at most
    strata x measures x 101 levels come to the driver."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good"))
    known = counts.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), *[measure(m).alias(m) for m in MEASURES]).join(marked, "doc_id")
    levels = known.select("stratum", "_good", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.ceil(F.col(m) / STEP).cast("int").alias("level")) for m in MEASURES])).alias("x"))
    found = levels.groupBy("stratum", "_good", "x.m", "x.level").count().collect()
    size = 1000 // STEP + 1
    hist: dict = {}
    for r in found:
        hist.setdefault((r["stratum"], r["m"]), np.zeros((2, size + 1), int))[int(r["_good"] > 0), min(r["level"], size)] += r["count"]
    strata = len({s for s, _ in hist})
    return {key: cut for key, h in hist.items() if (cut := tightest(h, risk / len(MEASURES), delta / (strata * len(MEASURES)))) is not None}


def tightest(hist: np.ndarray, alpha: float, delta: float) -> int | None:
    """hist: bad and good documents by level; level L holds measures in ((L - 1) * STEP, L * STEP]."""
    above = hist[:, ::-1].cumsum(1)[:, ::-1]
    good, best, cut = int(hist[1].sum()), 0, None
    for level in range(hist.shape[1] - 2, -1, -1):
        bad_lost, good_lost = int(above[0, level + 1]), int(above[1, level + 1])
        if good_lost > alpha * good or at_most(good_lost, good, alpha) > delta:
            break
        if bad_lost - good_lost > best:
            best, cut = bad_lost - good_lost, level * STEP
    return cut


def judged(counts: DataFrame, cuts: dict, stratum: str = "lang") -> DataFrame:
    """counts -> also base_failed and kept."""
    bad = F.lit(False)
    for (name, m), cut in sorted(cuts.items(), key=repr):
        bad = bad | (F.col(stratum).eqNullSafe(F.lit(name)) & (measure(m) > cut))
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counts = Stage(spark, "quality").write(measured(docs.select("doc_id", "lang", "text")).drop("text"), "counts")
    return judged(counts, cutoffs(counts, labels)).select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs. Texts are counted once and written with their counts."""
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in (*COUNTS, "base_failed", "kept")}
    counted = Stage(docs.sparkSession, "quality").write(measured(docs.withColumnsRenamed(own)), "counted")
    kept = judged(counted, cutoffs(counted, labels)).where("kept")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


OP4_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
t AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, CASE WHEN lead(i, 2) OVER o IS NOT NULL THEN word || chr(9) || lead(word) OVER o || chr(9) || lead(word, 2) OVER o END AS tri
      FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, tri IS NOT NULL AND count(*) OVER (PARTITION BY r, tri) > 1 AS twice FROM g),
v AS (SELECT r, i, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS inside
      FROM h WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, CAST(count(*) FILTER (inside) AS BIGINT) AS n_repeat_words FROM v GROUP BY r),
c AS (
  SELECT w.r, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_marks
  FROM w LEFT JOIN n ON w.r = n.r),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [{'m': 'symbols', 'v': n_symbols * 1000 // greatest(word_chars, 1)}, {'m': 'marks', 'v': n_marks * 1000 // greatest(word_chars, 1)},
          {'m': 'upper', 'v': n_upper * 1000 // greatest(word_chars, 1)}, {'m': 'repeats', 'v': n_repeat_words * 1000 // greatest(n_words, 1)},
          {'m': 'dup_lines', 'v': n_dup_lines * 1000 // greatest(n_lines, 1)}] AS ms FROM c),
l AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT lang, good, unnest(ms) AS x FROM m JOIN l USING (doc_id) WHERE NOT base_failed),
q AS (SELECT lang, x.m AS m, count(*) FILTER (good > 0) AS n FROM k GROUP BY ALL),
s AS (SELECT count(DISTINCT coalesce(lang, '')) AS strata FROM k),
u AS (
  SELECT q.lang, q.m, q.n, cut, count(*) FILTER (good > 0 AND x.v > cut) AS good_lost, count(*) FILTER (good <= 0 AND x.v > cut) AS bad_lost
  FROM q JOIN k ON q.lang IS NOT DISTINCT FROM k.lang AND q.m = k.x.m CROSS JOIN (SELECT unnest(range(0, 1001, 10)) AS cut) GROUP BY ALL),
z AS (
  SELECT *, CASE WHEN good_lost > 0.01 * n OR n = 0 THEN 1
       ELSE list_sum(list_transform(range(0, good_lost + 1), lambda i: exp((CASE WHEN n > 0 THEN lgamma(n + 1) ELSE 0 END) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END
       > 0.05 / (strata * 5) AS fails FROM u, s),
y AS (SELECT *, max(CASE WHEN fails THEN 1 ELSE 0 END) OVER (PARTITION BY lang, m ORDER BY cut DESC ROWS UNBOUNDED PRECEDING) AS stopped FROM z),
b AS (
  SELECT lang, m, cut FROM y WHERE stopped = 0 AND bad_lost > good_lost
  QUALIFY row_number() OVER (PARTITION BY lang, m ORDER BY bad_lost - good_lost DESC, cut DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM b WHERE b.lang IS NOT DISTINCT FROM m.lang AND list_filter(m.ms, lambda e: e.m = b.m)[1].v > b.cut) AS kept
FROM m
"""
