"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from draftmill.llm import bpe, decontaminate, fingerprints, language_id, lm_score, near_dedup, resampling, sharding, substring_dedup, token_counts, token_files, url_filter, vector_codes

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_recurrent_lm_score": lm_score.op3_recurrent_lm_score,
    "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
    "op5_trie_token_counts": token_counts.op5_trie_token_counts,
    "op6_kd_tree_sharding": sharding.op6_kd_tree_sharding,
    "op7_wavelet_token_files": token_files.op7_wavelet_token_files,
    "op8_closed_syncmers": fingerprints.op8_closed_syncmers,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_bpe_automaton": bpe.op10_bpe_automaton,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_va_file_codes": vector_codes.op12_va_file_codes,
    "op13_url_filter": url_filter.op13_url_filter,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_minhash_near_dedup": near_dedup.OP4_SQL,
    "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_va_file_codes": vector_codes.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
