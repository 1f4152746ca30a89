"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from quietab.llm import (audit, decontam, langid, licences, ngrams, packing, quality, search, simhash,
                         token_counts, token_files, toxicity, urls)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_licence_scan": licences.op2_licence_scan,
    "op3_benchmark_decontamination": decontam.op3_benchmark_decontamination,
    "op4_language_id": langid.op4_language_id,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_token_files": token_files.op6_token_files,
    "op7_packing": packing.op7_packing,
    "op8_url_filter": urls.op8_url_filter,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_filter_interaction_audit": audit.op11_filter_interaction_audit,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_lm_scoring": ngrams.op13_lm_scoring,
}

ORACLES: dict[str, str] = {"op8_url_filter": urls.OP8_SQL, "op11_filter_interaction_audit": audit.OP11_SQL,
                           "op12_ranked_search": search.OP12_SQL}
