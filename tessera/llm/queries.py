"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import bitplane, cross_polytope, host_rules, lexical, link_graph, media, merkle, mixing, near_dup, packing, suffix_levels, toxicity, word_windows

QUERIES = {
    "op1_bitplane_tokens": bitplane.op1_bitplane_tokens,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_suffix_levels": suffix_levels.op4_suffix_levels,
    "op5_poisson_mix": mixing.op5_poisson_mix,
    "op6_word_windows": word_windows.op6_word_windows,
    "op7_host_rules": host_rules.op7_host_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_media_columns": media.op9_media_columns,
    "op10_link_graph": link_graph.op10_link_graph,
    "op11_embedding_dup": cross_polytope.op11_embedding_dup,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op2_near_dup": near_dup.ORACLE,
    "op5_poisson_mix": mixing.ORACLE,
    "op6_word_windows": word_windows.ORACLE,
    "op7_host_rules": host_rules.ORACLE,
    "op10_link_graph": link_graph.ORACLE,
    "op11_embedding_dup": cross_polytope.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
