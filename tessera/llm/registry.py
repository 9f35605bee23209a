"""Queries of the training-data operators, and oracle SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import decontaminate, hamming, histogram_shards, jaccard_join, language, licences, packing, quality, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_hamming_topk": hamming.op2_hamming_topk,
    "op3_histogram_shards": histogram_shards.op3_histogram_shards,
    "op4_licence_scan": licences.op4_licence_scan,
    "op5_warc_revisits": warc.op5_warc_revisits,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_language_id": language.op8_language_id,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_hamming_topk": hamming.OP2_SQL,
    "op4_licence_scan": licences.OP4_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
}
