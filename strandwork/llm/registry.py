"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, chat_format, fingerprints, language_id, line_dedup, mixing, ngram_join, quality_rules, substring_dedup, token_counts

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality_rules": quality_rules.query,
    "op3_fingerprints": fingerprints.query,
    "op4_ngram_join": ngram_join.query,
    "op5_chat_format": chat_format.query,
    "op6_language_id": language_id.query,
    "op7_line_dedup": line_dedup.query,
    "op8_bpe": bpe.query,
    "op9_token_counts": token_counts.query,
    "op10_substring_dedup": substring_dedup.query,
    # What two of the operators also return.
    "mixing_targets": mixing.target_query,
    "quality_ablations": quality_rules.ablation_query,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    "mixing_targets": mixing.TARGET_SQL,
    "quality_ablations": quality_rules.ABLATION_SQL,
}
