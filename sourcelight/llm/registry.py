"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sourcelight.llm.op1_tokens import op1_token_counts
from sourcelight.llm.op2_ngram_join import op2_ngram_jaccard
from sourcelight.llm.op3_fingerprint import op3_fingerprints
from sourcelight.llm.op4_mix import op4_mix_sources
from sourcelight.llm.op5_decontaminate import op5_benchmark_decontamination
from sourcelight.llm.op6_language import op6_language_id
from sourcelight.llm.op7_html import op7_html_text
from sourcelight.llm.op8_toxicity import op8_toxicity
from sourcelight.llm.op9_substrings import op9_substring_dedup
from sourcelight.llm.op10_lines import op10_line_dedup
from sourcelight.llm.op11_alignment import op11_cross_tokenizer
from sourcelight.llm.op12_negatives import op12_hard_negatives
from sourcelight.llm.op13_license import op13_license_scan

QUERIES = [
    op1_token_counts, op2_ngram_jaccard, op3_fingerprints, op4_mix_sources, op5_benchmark_decontamination, op6_language_id, op7_html_text,
    op8_toxicity, op9_substring_dedup, op10_line_dedup, op11_cross_tokenizer, op12_hard_negatives, op13_license_scan,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from sourcelight.llm import sql

    return sql.ORACLES
