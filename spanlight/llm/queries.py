"""Queries of this package's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, collocations, html_text, language_id, lm_scoring, media, mixing, near_dedup, quality, substring_dedup, suffix_dedup, warc, whitening

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_stupid_backoff": lm_scoring.op5_stupid_backoff,
    "op5_stupid_backoff_all": lm_scoring.op5_stupid_backoff,
    "op5_turns_under_documents": lm_scoring.op5_turns_under_documents,
    "op6_lossless_webp": media.op6_lossless_webp,
    "op7_language_id": language_id.op7_language_id,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op9_distinct_words": byte_bpe.op9_distinct_words,
    "op10_mixing": mixing.op10_mixing,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

ORACLE_SQL = {
    "op4_quality_rules": quality.OP4_SQL,
    "op5_stupid_backoff": lm_scoring.OP5_SQL,
    "op5_stupid_backoff_all": lm_scoring.OP5_SQL,
    "op5_turns_under_documents": lm_scoring.OP5_TURNS_SQL,
    "op8_warc_revisits": warc.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
    "op13_substring_dedup": substring_dedup.OP13_SQL,
}
