"""Queries of the training-data operators, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waveloom.llm import op8_minhash_dedup as op8_minhash_dedup_module
from waveloom.llm import op10_license_scan as op10_license_scan_module
from waveloom.llm import op11_exact_dedup as op11_exact_dedup_module
from waveloom.llm import op12_prefix_trie as op12_prefix_trie_module
from waveloom.llm import op13_centroid_clustering as op13_centroid_clustering_module
from waveloom.llm.op1_quality_rules import op1_quality_rules
from waveloom.llm.op2_lm_scoring import op2_lm_scoring
from waveloom.llm.op3_suffix_dedup import op3_suffix_dedup
from waveloom.llm.op4_pii_surrogates import op4_pii_surrogates
from waveloom.llm.op5_best_fit_packing import op5_best_fit_packing
from waveloom.llm.op6_language_id import op6_language_id
from waveloom.llm.op7_template_decontamination import op7_template_decontamination
from waveloom.llm.op8_minhash_dedup import op8_minhash_dedup
from waveloom.llm.op9_token_counts import op9_token_counts
from waveloom.llm.op10_license_scan import op10_license_scan
from waveloom.llm.op11_exact_dedup import op11_exact_dedup
from waveloom.llm.op12_prefix_trie import op12_prefix_trie
from waveloom.llm.op13_centroid_clustering import op13_centroid_clustering

OPERATORS = (op1_quality_rules, op2_lm_scoring, op3_suffix_dedup, op4_pii_surrogates, op5_best_fit_packing, op6_language_id, op7_template_decontamination, op8_minhash_dedup, op9_token_counts, op10_license_scan, op11_exact_dedup, op12_prefix_trie, op13_centroid_clustering)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op8_minhash_dedup": op8_minhash_dedup_module.SQL, "op10_license_scan": op10_license_scan_module.SQL, "op11_exact_dedup": op11_exact_dedup_module.SQL, "op12_prefix_trie": op12_prefix_trie_module.SQL, "op13_centroid_clustering": op13_centroid_clustering_module.SQL}
