"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, chat, decontaminate, filter_audit, html_text, language, line_dedup, minhash, neighbours, pii, ppm, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator over its whole table."""
    return {
        "op1_pii": pii.op1_pii,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_chat": chat.op4_chat,
        "op5_ppm": ppm.op5_ppm,
        "op6_minhash": minhash.op6_minhash,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_html": html_text.op10_html,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_whitening": whitening.op12_whitening,
        "op13_language": language.op13_language,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against plain Python."""
    return {"op4_chat": chat.OP4_SQL, "op6_minhash": minhash.OP6_SQL, "op7_line_dedup": line_dedup.OP7_SQL, "op11_filter_audit": filter_audit.OP11_SQL}
