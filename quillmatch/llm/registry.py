"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import (
    q01_decontamination,
    q02_toxicity,
    q03_lm_scoring,
    q04_substring_dedup,
    q05_language_id,
    q06_packing,
    q07_fingerprints,
    q08_token_counts,
    q09_url_filter,
    q10_near_duplicates,
    q11_quality,
    q12_source_divergence,
    q13_whitening,
)

_MODULES = (q01_decontamination, q02_toxicity, q03_lm_scoring, q04_substring_dedup, q05_language_id, q06_packing, q07_fingerprints, q08_token_counts, q09_url_filter, q10_near_duplicates, q11_quality, q12_source_divergence, q13_whitening)


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict:
    found = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
