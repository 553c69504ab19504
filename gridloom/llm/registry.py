"""Queries and SQL of the training-data operators, for the entry point."""

from __future__ import annotations

from gridloom.llm import chat, decontamination, language, licenses, packing, quality, quality_rules, simhash, substrings, url_filter

MODULES = {
    "op1_substring_dedup": substrings,
    "op2_license_scan": licenses,
    "op3_chat_format": chat,
    "op4_quality_rules": quality_rules,
    "op5_language_id": language,
    "op6_simhash": simhash,
    "op7_quality_classifier": quality,
    "op8_decontamination": decontamination,
    "op9_url_filter": url_filter,
    "op10_packing": packing,
}


def queries():
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql():
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
