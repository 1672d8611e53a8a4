"""Queries of the package: one per operator, and the pipeline."""

import corpus_pipeline

from . import (centroid_clustering, decontaminate, language_id, license_scan, line_dedup, mixing, near_dedup, prefix_trie,
               quality_pairs, quality_rules, suffix_dedup, token_output, toxicity)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_pairs": quality_pairs.op3_quality_pairs,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_output": token_output.op6_token_output,
    "op7_language_id": language_id.op7_language_id,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
    "op13_toxicity": toxicity.op13_toxicity,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op8_line_dedup": line_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_centroid_clustering": centroid_clustering.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
