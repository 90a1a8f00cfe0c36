"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytolith.llm import conversation_repair, decontamination, fill_middle, html_text, language_crf, licenses, packing, permutation_index, pii, quality, simhash, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op9_html_text": html_text.query,
    "op1_licenses": licenses.query,
    "op10_permutation_index": permutation_index.query,
    "op2_decontamination": decontamination.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_token_counts": token_counts.query,
    "op5_pii": pii.query,
    "op6_quality": quality.query,
    "op7_best_two_fit_packing": packing.query,
    "op8_simhash_near_dedup": simhash.query,
    "op11_fill_middle": fill_middle.query,
    "op12_language_crf": language_crf.query,
    "op13_conversation_repair": conversation_repair.query,
}

#: The others read models, tokens, hashes or streams that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op2_decontamination": decontamination.oracle(),
    "op3_suffix_dedup": suffix_dedup.oracle(),
}
