"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from . import exact_dedup, fingerprint, html_template, ngram_join, packing, quality, source_mix, substring_chain, toxicity, warc


def queries() -> dict:
    return {f.__name__: f for f in (substring_chain.op1_substring_chain, ngram_join.op2_ngram_join, source_mix.op3_source_mix, html_template.op4_html_main_text, quality.op5_quality, toxicity.op6_toxicity, packing.op7_best_fit_packing, exact_dedup.op8_exact_dedup, warc.op9_warc, fingerprint.op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": source_mix.SQL, "op8_exact_dedup": exact_dedup.SQL, "op9_warc": warc.SQL}
