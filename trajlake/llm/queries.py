"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from trajlake.llm import (
    decontamination,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    ngram_jaccard,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    substring_dedup,
    url_filters,
    whitening,
)

QUERIES = {
    "op1_quality_rules": (quality_rules.op1_quality_rules, quality_rules.SQL),
    "op2_lm_scoring": (lm_scoring.op2_lm_scoring, lm_scoring.SQL),
    "op3_license_scan": (license_scan.op3_license_scan, license_scan.SQL),
    "op4_substring_dedup": (substring_dedup.op4_substring_dedup, substring_dedup.SQL),
    "op5_url_filters": (url_filters.op5_url_filters, url_filters.SQL),
    "op6_ngram_jaccard": (ngram_jaccard.op6_ngram_jaccard, ngram_jaccard.SQL),
    "op7_mixing": (mixing.op7_mixing, mixing.SQL),
    "op8_decontamination": (decontamination.op8_decontamination, decontamination.SQL),
    "op9_language_id": (language_id.op9_language_id, language_id.SQL),
    "op10_quality_classifier": (quality_classifier.op10_quality_classifier, quality_classifier.SQL),
    "op11_periodic_runs": (periodic_runs.op11_periodic_runs, periodic_runs.SQL),
    "op12_packing": (packing.op12_packing, packing.SQL),
    "op13_embedding_whitening": (whitening.op13_embedding_whitening, whitening.SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
