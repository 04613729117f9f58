"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, line_dedup, mixing, ngram_join, suffix_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_mixing": mixing.op4_mixing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL = {
    "op2_url_filters": url_filters.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
}
