"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from . import ctw, decontaminate, dedup, html, langid, licenses, lines, mixing, quality, sharding

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language_id": langid.op2_language_id,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_near_duplicates": dedup.op4_near_duplicates,
    "op5_lm_scoring": ctw.op5_lm_scoring,
    "op6_sharding": sharding.op6_sharding,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_html_extraction": html.op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE_SQL,
    "op4_near_duplicates": dedup.ORACLE_SQL,
    "op6_sharding": sharding.oracle_sql(),
    "op7_license_scan": licenses.oracle_sql(),
    "op9_quality_rules": quality.oracle_sql(),
}
