"""The thin queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from mailgauge.llm import bpe, conversations, fingerprints, licenses, line_dedup, mixing, prefix_bpe, quality_classifier, quality_rules, resampling, simhash, suffix_dedup, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_near_dedup,
        suffix_dedup.op2_suffix_dedup,
        url_filter.op3_url_filter,
        mixing.op4_source_mixing,
        fingerprints.op5_document_fingerprints,
        licenses.op6_license_scan,
        quality_rules.op7_quality_rules,
        quality_classifier.op8_quality_classifier,
        line_dedup.op9_line_dedup,
        bpe.op10_byte_bpe,
        prefix_bpe.op11_prefix_bpe,
        conversations.op12_conversation_repair,
        resampling.op13_importance_resampling,
    )
}
ORACLES = {"op4_source_mixing": mixing.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op12_conversation_repair": conversations.ORACLE, "op13_importance_resampling": resampling.ORACLE}
