"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprints, language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_counts, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_warc_boundary_chain": warc.op2_warc_boundary_chain,
    "op3_mixing": mixing.op3_mixing,
    "op4_language_id": language_id.op4_language_id,
    "op5_bottom_k_fingerprints": fingerprints.op5_bottom_k_fingerprints,
    "op6_edit_aware_tokens": token_counts.op6_edit_aware_tokens,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_suffix_array_dedup": substring_dedup.op8_suffix_array_dedup,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    # op8's groups with all occurrences, of which op8 cuts the union.
    "maximal_repeat_groups": substring_dedup.maximal_repeat_groups,
}

ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_warc_boundary_chain": warc.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op8_suffix_array_dedup": substring_dedup.OP8_SQL,
    "op9_minhash_near_dedup": near_dedup.OP9_SQL,
}
