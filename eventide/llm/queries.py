"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from eventide.llm import (
    op1_toxicity, op2_packing, op3_bpe, op4_language, op5_embedding_dedup, op6_html, op7_topk, op8_simhash, op9_license,
    op10_rans, op11_suffix_dedup, op12_collocations, op13_divergence,
)

QUERIES = {
    "op1_toxicity_compression": op1_toxicity.query,
    "op2_best_fit_packing": op2_packing.query,
    "op3_byte_bpe": op3_bpe.query,
    "op4_language_profiles": op4_language.query,
    "op5_embedding_dedup": op5_embedding_dedup.query,
    "op6_html_blocks": op6_html.query,
    "op7_topk_va_file": op7_topk.query,
    "op8_simhash_golay": op8_simhash.query,
    "op9_license_diagonals": op9_license.query,
    "op10_rans_blocks": op10_rans.query,
    "op11_suffix_dedup": op11_suffix_dedup.query,
    "op12_phrase_collocations": op12_collocations.query,
    "op13_source_divergence": op13_divergence.query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_embedding_dedup": op5_embedding_dedup.oracle_sql(),
    "op7_topk_va_file": op7_topk.oracle_sql(),
    "op9_license_diagonals": op9_license.oracle_sql(),
    "op12_phrase_collocations": op12_collocations.oracle_sql(),
    "op13_source_divergence": op13_divergence.oracle_sql(),
}
