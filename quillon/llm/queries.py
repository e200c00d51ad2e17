"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillon.llm import (
    brown,
    content,
    gam,
    hostrank,
    hyperdim,
    packing,
    qalsh,
    simhash,
    tokencounts,
    winnowing,
)

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_token_counts": tokencounts.op2_token_counts,
    "op3_quality_classifier": gam.op3_quality_classifier,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_nearest_neighbours": qalsh.op5_nearest_neighbours,
    "op6_benchmark_decontamination": winnowing.op6_benchmark_decontamination,
    "op7_url_filter": hostrank.op7_url_filter,
    "op8_html_extraction": content.op8_html_extraction,
    "op9_class_lm_scores": brown.op9_class_lm_scores,
    "op10_language_id": hyperdim.op10_language_id,
}

ORACLE_SQL = {
    "op6_benchmark_decontamination": winnowing.ORACLE_SQL,
    "op7_url_filter": hostrank.ORACLE_SQL,
    "op8_html_extraction": content.ORACLE_SQL,
}
