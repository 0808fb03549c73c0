"""The queries of this subpackage, with their SQL where DuckDB can express them."""

from __future__ import annotations

from ashlar.llm import chat_format, decontaminate, exact_dedup, hard_negatives, html_text, language_id, line_dedup, mixing, packing, sharding, simhash, suffix_dedup, whitening

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op11_pack": packing.op11_pack,
    "op12_whiten": whitening.op12_whiten,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op6_chat_format": chat_format.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
