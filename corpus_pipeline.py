"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlight.llm import byte_bpe, mixing, near_dedup, quality, suffix_dedup
from spanlight.llm.frames import Stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8 and more) stays, the one of the smallest doc_id."""
    return near_dedup.kept_documents(docs, near_dedup.STAGE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat elsewhere leave the texts; n_chars follows."""
    return suffix_dedup.trimmed_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their digests."""
    import public_tokenizers

    out = byte_bpe.encode(docs, public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN, with_ids=True)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("byte-level BPE", tokens),
]

#: BPE can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for i, (_, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), str(i))
        if i:
            stage.drop(str(i - 1))
    return docs
