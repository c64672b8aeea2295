"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sigmafold.llm import exact_dedup, fingerprints, html_extract, language_id, lm_scoring, mixing, near_duplicates, packing, quality, token_output

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_mixing": mixing.op3_mixing,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_near_duplicates": near_duplicates.op5_near_duplicates,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_output": token_output.op7_token_output,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_quality": quality.op9_quality,
    "op10_packing": packing.op10_packing,
}

ORACLES = {
    "op3_mixing": mixing.ORACLE,
    "op5_near_duplicates": near_duplicates.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
}
