"""Registered queries of the training-data operators, and their SQL."""

from pulsegrid.llm import (
    bpe,
    exact_dedup,
    fertility,
    hard_negatives,
    html_text,
    licenses,
    mixing,
    near_dedup,
    packing,
    periodic_runs,
    sharding,
    urls,
    warc,
)

QUERIES = {
    "op1_cube_mixing": mixing.op1_cube_mixing,
    "op2_bm25_packing": packing.op2_bm25_packing,
    "op3_rare_token_index": licenses.op3_rare_token_index,
    "op4_tokeniser_fertility": fertility.op4_tokeniser_fertility,
    "op5_seekable_zstd": warc.op5_seekable_zstd,
    "op6_bbit_minhash": near_dedup.op6_bbit_minhash,
    "op7_boosted_url_trees": urls.op7_boosted_url_trees,
    "op8_block_rules": html_text.op8_block_rules,
    "op9_vector_bin_packing": sharding.op9_vector_bin_packing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_segment_summaries": hard_negatives.op11_segment_summaries,
    "op12_segment_tree_bpe": bpe.op12_segment_tree_bpe,
    "op13_minimizer_runs": periodic_runs.op13_minimizer_runs,
}

#: Verdicts of tokenisers, models and greedy methods have no SQL; tests/llm holds
#: those queries against brute force.
ORACLE_SQL = {
    "op5_seekable_zstd": warc.SQL,
    "op6_bbit_minhash": near_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_segment_summaries": hard_negatives.SQL,
}
