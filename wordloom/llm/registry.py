"""Queries over the test tables and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, html_text, language_model, licences, lines, neardup, packing, pii, quality, sharding


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run, "op1_packing": packing.op1_packing, "op2_licences": licences.op2_licences, "op3_sharding": sharding.op3_sharding, "op4_quality": quality.op4_quality, "op5_pii": pii.op5_pii, "op6_language_model": language_model.op6_language_model, "op7_line_dedup": lines.op7_line_dedup, "op8_html_text": html_text.op8_html_text, "op9_near_duplicates": neardup.op9_near_duplicates, "op10_decontaminate": decontaminate.op10_decontaminate}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": quality.SQL, "op7_line_dedup": lines.SQL, "op9_near_duplicates": neardup.SQL, "op10_decontaminate": decontaminate.SQL}
