"""The corpus queries and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, language_id, line_dedup, lm_score, merkle, near_dedup, quality_classifier, quality_rules, resampling, substring_dedup, token_files, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_minhash": near_dedup.op2_minhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_language_id": language_id.op7_language_id,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_resample": resampling.op11_resample,
    "op12_token_files": token_files.op12_token_files,
    "op13_merkle": merkle.op13_merkle,
}
ORACLE_SQL = {
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_resample": resampling.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
