"""The subpackage's queries and their SQL."""

from __future__ import annotations

from terrace.llm import co_training, collision_knn, histogram_packing, piece_scan, prefix_trie, quality_rules, secret_scan, separator_scan, simhash_trie, spelling_variants, style_tree, telephony_audio, warc_zstd

QUERIES = {
    "op1_warc_dictionary": warc_zstd.op1_warc_dictionary,
    "op2_site_style_tree": style_tree.op2_site_style_tree,
    "op3_collision_knn": collision_knn.op3_collision_knn,
    "op4_separator_scan": separator_scan.op4_separator_scan,
    "op5_co_training": co_training.op5_co_training,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_histogram_packing": histogram_packing.op7_histogram_packing,
    "op8_piece_scan": piece_scan.op8_piece_scan,
    "op9_telephony_audio": telephony_audio.op9_telephony_audio,
    "op10_simhash_near_dedup": simhash_trie.op10_simhash_near_dedup,
    "op11_conversation_trie": prefix_trie.op11_conversation_trie,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}

#: The others are tested against brute force: they tokenise, train, search, parse HTML or hash with XXH64.
ORACLES = {
    "op1_warc_dictionary": warc_zstd.ORACLE,
    "op6_secret_scan": secret_scan.oracle_sql(),
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_quality_rules": quality_rules.oracle_sql(),
}
