"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from harrow.llm import fingerprint, hard_negatives, html_text, importance, line_dedup, mixing, near_dup, neighbours, packing, pipeline, substring_dedup, toxicity, url_filter, vector_dup


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_packing": packing.op2_packing,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_mixing": mixing.op4_mixing,
        "op5_html_text": html_text.op5_html_text,
        "op6_fingerprint": fingerprint.op6_fingerprint,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_near_dup": near_dup.op8_near_dup,
        "op9_vector_dup": vector_dup.op9_vector_dup,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_neighbours": neighbours.op13_neighbours,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op8_near_dup": near_dup.OP8_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
    }
