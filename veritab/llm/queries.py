"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from veritab.llm import (
    conversation_trie, decontaminate, jaccard_join, line_dedup, mix_sources, pii, projected_search, quality, substring_dedup, tiered_search,
    token_planes, toxicity, warc_writer,
)

QUERIES = {
    "op1_token_planes": token_planes.op1_token_planes,
    "op2_contextual_pii": pii.op2_contextual_pii,
    "op3_pivotal_mix": mix_sources.op3_pivotal_mix,
    "op4_warc_dictionary": warc_writer.op4_warc_dictionary,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_toxicity_grades": toxicity.op7_toxicity_grades,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_projected_neighbours": projected_search.op9_projected_neighbours,
    "op10_nbsvm_quality": quality.op10_nbsvm_quality,
    "op11_prefix_trie": conversation_trie.op11_prefix_trie,
    "op12_line_runs": line_dedup.op12_line_runs,
    "op13_tiered_search": tiered_search.op13_tiered_search,
}

ORACLE_SQL = {
    "op4_warc_dictionary": warc_writer.ORACLE_SQL,
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_prefix_trie": conversation_trie.ORACLE_SQL,
    "op12_line_runs": line_dedup.ORACLE_SQL,
    "op13_tiered_search": tiered_search.ORACLE_SQL,
}
