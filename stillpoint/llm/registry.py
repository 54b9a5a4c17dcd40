"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from stillpoint.llm import compression, fingerprints, jaccard, language, line_dedup, packing, periodic, quality, resampling, suffix_dedup, topk, toxicity, word_bpe
from stillpoint.llm.common import bounded_batches


def _bounded(query):
    def run(spark, sf_dir):
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
        "op2_bpe_encode_decode": word_bpe.op2_bpe_encode_decode,
        "op3_exact_top_k": topk.op3_exact_top_k,
        "op4_language_id": language.op4_language_id,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality.op6_quality,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_quality_rules": compression.op12_quality_rules,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }
    return {name: _bounded(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {**line_dedup.ORACLE, **topk.ORACLE, **resampling.ORACLE}
