"""Queries of the corpus operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from folioforge.llm import chat, decontaminate, html, lines, neardup, packing, pii, quality, urls, warc


def queries() -> dict:
    return {
        "op1_url_filters": urls.op1_url_filters,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_warc": warc.op4_warc,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_chat_format": chat.op6_chat_format,
        "op7_minhash_dedup": neardup.op7_minhash_dedup,
        "op8_html_extraction": html.op8_html_extraction,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_url_filters": urls.SQL,
        "op2_decontaminate": decontaminate.SQL,
        "op4_warc": warc.SQL,
        "op5_quality_rules": quality.SQL,
        "op6_chat_format": chat.SQL,
        "op7_minhash_dedup": neardup.SQL,
        "op9_line_dedup": lines.SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
