"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from krysalis.llm import alignment, bpe, chat, classifier, exact, mixing, negatives, packing, pages, quality, secrets, simhash, suffixes

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_lm_scoring": mixing.op3_lm_scoring,
    "op4_bpe_encode_decode": bpe.op4_bpe_encode_decode,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_html_extraction": pages.op7_html_extraction,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_quality_classifier": classifier.op13_quality_classifier,
}

ORACLES = {"op5_exact_dedup": exact.OP5_SQL, "op9_chat_format": chat.OP9_SQL, "op12_hard_negatives": negatives.OP12_SQL}
