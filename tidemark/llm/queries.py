"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import decontam, licenses, lmscore, merkle, mixing, negatives, ngramjoin, packing, quality, substring, tokens, urls, warc

QUERIES = {
    "op1_context_tree_score": lmscore.op1_context_tree_score,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_warc": warc.op3_warc,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_ngram_jaccard_join": ngramjoin.op5_ngram_jaccard_join,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_url_filters": urls.op7_url_filters,
    "op8_benchmark_leaks": decontam.op8_benchmark_leaks,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
    "license_lines": licenses.license_lines,
}

ORACLE = {
    "op2_quality_rules": quality.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_ngram_jaccard_join": ngramjoin.OP5_SQL,
    "op7_url_filters": urls.OP7_SQL,
    "op9_substring_dedup": substring.OP9_SQL,
    "op10_license_scan": licenses.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "license_lines": licenses.LINES_SQL,
}
