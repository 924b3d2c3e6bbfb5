"""Queries of the corpus operators, one per operator, over their whole tables."""

from __future__ import annotations

import corpus_pipeline
from pairwright.llm import centroids, counts, decontaminate, jaccard, licenses, lines, mixing, pages, personal, quality, secrets, toxicity, variants

QUERIES = {
    "op1_line_dedup": lines.query,
    "op2_jaccard_join": jaccard.query,
    "op3_toxicity": toxicity.query,
    "op4_decontaminate": decontaminate.query,
    "op5_token_counts": counts.query,
    "op6_extract_pages": pages.query,
    "op7_quality_rules": quality.query,
    "op8_license_scan": licenses.query,
    "op9_mix_sources": mixing.query,
    "op10_secret_scan": secrets.query,
    "op11_personal_data": personal.query,
    "op12_spelling_variants": variants.query,
    "op13_dual_tree_lloyd": centroids.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_line_dedup": lines.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
    "op10_secret_scan": secrets.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_dual_tree_lloyd": centroids.ORACLE,
}
