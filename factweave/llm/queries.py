"""The queries of this folder and their SQL, for the entry file."""

from __future__ import annotations

from . import decontam, exact_dedup, html_text, language, line_dedup, media, mixing, near_dedup, negatives, packing, quality, spelling, substrings

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_media_columns": media.op5_media_columns,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_decontam": decontam.op12_decontam,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_source_mix": mixing.SQL,
    "op11_spelling": spelling.SQL,
    "op12_decontam": decontam.SQL,
    "op13_hard_negatives": negatives.SQL,
}
