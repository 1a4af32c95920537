"""Operators for training-data corpora. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from . import ann, byte_bpe, chat_format, exact_dedup, html_text, language_id, line_dedup, line_quality, packing, simhash


def queries() -> dict:
    return {
        "op1_ann_multiprobe": ann.op1_ann_multiprobe,
        "op2_language_id": language_id.op2_language_id,
        "op3_chat_formatting": chat_format.op3_chat_formatting,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_quality_classifier": line_quality.op7_quality_classifier,
        "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_html_extraction": html_text.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": chat_format.SQL, "op4_exact_dedup": exact_dedup.SQL, "op5_line_dedup": line_dedup.SQL}
