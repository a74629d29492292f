"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_language": "op01_language",
    "op2_media": "op02_media",
    "op3_ngram_join": "op03_ngram_join",
    "op4_substring_dedup": "op04_substring_dedup",
    "op5_line_dedup": "op05_line_dedup",
    "op6_token_counts": "op06_token_counts",
    "op7_decontamination": "op07_decontamination",
    "op8_toxicity": "op08_toxicity",
    "op9_token_ids": "op09_token_ids",
    "op10_packing": "op10_packing",
    "op11_fill_in_middle": "op11_fill_in_middle",
    "op12_importance_resampling": "op12_importance_resampling",
    "op13_html_extraction": "op13_html_extraction",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in _QUERIES.items() if (sql := getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None))}
