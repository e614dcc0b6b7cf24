"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Module and query of each operator.
OPERATORS = {
    "embeddings": "op3_embedding_near_dedup",
    "simhash": "op7_simhash_near_dedup",
    "quality_rules": "op10_quality_rules",
    "line_dedup": "op6_line_dedup",
    "mixing": "op2_mix_sources",
    "bpe": "op4_byte_bpe",
    "token_shards": "op9_token_shards",
    "quality_model": "op8_quality_model",
    "substring_dedup": "op1_substring_dedup",
    "pii": "op5_pii_pseudonyms",
    "conversation_repair": "op11_conversation_repair",
    "filter_audit": "op12_filter_audit",
    "suffix_dedup": "op13_suffix_dedup",
}


def queries() -> dict:
    return {query: getattr(importlib.import_module(f"chartloom.llm.{module}"), query) for module, query in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {query: getattr(importlib.import_module(f"chartloom.llm.{module}"), "ORACLE_SQL", None) for module, query in OPERATORS.items()}
    return {k: v for k, v in found.items() if v}
