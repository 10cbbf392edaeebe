"""The registered query of each operator and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import bpe, chat_quotes, media_columns, near_join, paragraph_dedup, pii, quality_mil, quality_rules, source_mixing, url_filters

_MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_media_columns": media_columns,
    "op3_bpe": bpe,
    "op4_near_join": near_join,
    "op5_quote_linking": chat_quotes,
    "op6_url_filters": url_filters,
    "op7_source_mixing": source_mixing,
    "op8_paragraph_dedup": paragraph_dedup,
    "op9_quality_mil": quality_mil,
    "op10_pii": pii,
}
#: Those columns of an operator that SQL can express, where it can't express all.
_BASE = {"quality_rules_base": quality_rules, "pii_base": pii}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()} | {name: module.base_query for name, module in _BASE.items()}


def oracle_sql() -> dict[str, str]:
    whole = {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
    return whole | {name: module.BASE_SQL for name, module in _BASE.items()}
