"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from tidewise.llm import (conversation_repair, decontaminate, importance, language_id, license_scan, line_dedup, packing, pii,
                          quality_model, quality_rules, simhash, substring_dedup, warc)

QUERIES = {f.__name__: f for f in (
    quality_model.op1_quality_model, decontaminate.op2_decontaminate, packing.op3_hilbert_packing, language_id.op4_language_id,
    simhash.op5_simhash_neardup, warc.op6_warc,
    line_dedup.op7_line_dedup, license_scan.op8_license_scan, quality_rules.op9_quality_rules, pii.op10_pii_surrogates,
    substring_dedup.op11_substring_dedup, conversation_repair.op12_conversation_repair, importance.op13_importance_resampling)}

ORACLE = {"op6_warc": warc.OP6_SQL, "op7_line_dedup": line_dedup.OP7_SQL, "op11_substring_dedup": substring_dedup.OP11_SQL}
