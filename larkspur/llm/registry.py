"""Queries of the corpus operators and, where SQL can express them, the DuckDB SQL for the same rows."""

from __future__ import annotations

from larkspur.llm import bpe, language, leaks, lines, near, quality, recompression, rules, sql, suffixes, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_near_dedup": near.op3_near_dedup,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_substring_dedup": recompression.op5_substring_dedup,
    "op6_language_id": language.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_rules": rules.op8_quality_rules,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_decontamination": leaks.op10_decontamination,
}

ORACLES = {
    "op2_suffix_dedup": sql.op2(),
    "op3_near_dedup": sql.op3(),
    "op4_line_dedup": sql.op4(),
    "op5_substring_dedup": sql.op5(),
    "op8_quality_rules": sql.op8(),
    "op10_decontamination": sql.op10(),
}
