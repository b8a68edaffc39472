"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from colloquy.llm import bitplanes, decision_list, entropy_mix, external_shuffle, imatch, license_scan, pages, phrases, simhash, token_counts, transducer, turn_trie, url_rules

QUERIES = {
    "op1_page_differencing": pages.op1,
    "op2_quality_rules": decision_list.op2,
    "op3_bpe_transducer": transducer.op3,
    "op4_url_rules": url_rules.op4,
    "op5_bitplanes": bitplanes.op5,
    "op6_license_scan": license_scan.op6,
    "op7_entropy_mix": entropy_mix.op7,
    "op8_external_shuffle": external_shuffle.op8,
    "op9_simhash": simhash.op9,
    "op10_imatch": imatch.op10,
    "op11_token_counts": token_counts.op11,
    "op12_phrase_collocations": phrases.op12,
    "op13_turn_trie": turn_trie.op13,
}

#: Learned lists, merges, majority bits, planes and shuffles have no SQL form; tests/llm holds those to brute force.
ORACLE_SQL: dict[str, str] = {"op6_license_scan": license_scan.oracle_sql(), "op12_phrase_collocations": phrases.oracle_sql(), "op13_turn_trie": turn_trie.oracle_sql()}
