"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from flowlens.llm import (bpe, compression, htmltext, interpolation, kmtree, langid, ngramjoin, packing, periodic,
                          ruleensemble, sharding, urlfilter, whitening)

QUERIES = {
    "op1_url_filter": urlfilter.query,
    "op2_language_spans": langid.query,
    "op3_rule_ensemble": ruleensemble.query,
    "op4_kmeans_tree_search": kmtree.query,
    "op5_bpe_trie": bpe.query,
    "op6_extendible_hashing": sharding.query,
    "op7_compression_bands": compression.query,
    "op8_cutting_stock_packing": packing.query,
    "op9_ngram_jaccard_join": ngramjoin.query,
    "op10_wrapper_induction": htmltext.query,
    "op11_deleted_interpolation": interpolation.query,
    "op12_embedding_whitening": whitening.query,
    "op13_periodic_runs": periodic.query,
}
ORACLES = {
    "op1_url_filter": urlfilter.ORACLE_SQL,
    "op6_extendible_hashing": sharding.ORACLE_SQL,
}
