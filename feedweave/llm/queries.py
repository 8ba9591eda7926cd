"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from feedweave.llm import (
    best_fit_packing,
    byte_bpe,
    chat_perspectives,
    conversation_trie,
    license_scan,
    lm_scoring,
    ogg_media,
    quality_rules,
    simhash_dedup,
    source_mixing,
    spelling_variants,
    suffix_dedup,
    url_filters,
)

QUERIES = {
    "op1_ogg_media": ogg_media.op1_ogg_media,
    "op2_source_mixing": source_mixing.op2_source_mixing,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_best_fit_packing": best_fit_packing.op5_best_fit_packing,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_chat_perspectives": chat_perspectives.op8_chat_perspectives,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES = {
    "op3_license_scan": license_scan.oracle(),
    "op6_url_filters": url_filters.oracle(),
    "op8_chat_perspectives": chat_perspectives.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
}
