"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, langid, lexical, main_text, packing, pii, sharding, substring, topk, toxicity, url_filter, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_shards": sharding.op1_hilbert_shards,
        "op2_language_id": langid.op2_language_id,
        "op3_url_filters": url_filter.op3_url_filters,
        "op4_jaccard_components": jaccard.op4_jaccard_components,
        "op5_main_text": main_text.op5_main_text,
        "op6_benchmark_leaks": decontaminate.op6_benchmark_leaks,
        "op7_pii_spans": pii.op7_pii_spans,
        "op8_exact_topk": topk.op8_exact_topk,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_repeated_lines": substring.op10_repeated_lines,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_lexical_topk": lexical.op12_lexical_topk,
        "op13_toxic_spans": toxicity.op13_toxic_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filter.OP3_SQL,
        "op4_jaccard_components": jaccard.OP4_SQL,
        "op6_benchmark_leaks": decontaminate.OP6_SQL,
        "op7_pii_spans": pii.OP7_SQL,
        "op8_exact_topk": topk.OP8_SQL,
        "op10_repeated_lines": substring.OP10_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_lexical_topk": lexical.OP12_SQL,
    }
