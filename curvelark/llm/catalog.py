"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, bpe, hamming, langid, mixing, ngram_join, pivots, repeats, secrets, sharding, url_lists, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_url_list_join": url_lists.op3_url_list_join,
    "op4_prefix_sum_shards": sharding.op4_prefix_sum_shards,
    "op5_warc_zstd": warc.op5_warc_zstd,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_bpe": bpe.op7_bpe,
    "op8_kmeans_tree_search": ann.op8_kmeans_tree_search,
    "op9_language_id": langid.op9_language_id,
    "op10_hamming_topk": hamming.op10_hamming_topk,
    "op11_pivot_negatives": pivots.op11_pivot_negatives,
    "op12_seed_extend_dedup": repeats.op12_seed_extend_dedup,
}

ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op3_url_list_join": url_lists.ORACLE,
    "op4_prefix_sum_shards": sharding.ORACLE,
    "op5_warc_zstd": warc.ORACLE,
    "op10_hamming_topk": hamming.ORACLE,
    "op11_pivot_negatives": pivots.ORACLE,
    "op12_seed_extend_dedup": repeats.ORACLE,
}
