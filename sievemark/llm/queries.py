"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: module, query; the SQL, where there is any, is the module's ORACLE.
MODULES = {
    "exact_dedup": "op1_exact_dedup",
    "html_text": "op7_html_text",
    "mixing": "op3_mixing",
    "ngram_join": "op5_ngram_join",
    "packing": "op4_packing",
    "pii": "op8_personal_data",
    "quality": "op6_quality",
    "sharding": "op9_sharding",
    "token_output": "op10_token_output",
    "vector_dedup": "op2_vector_dedup",
}
#: Further queries: name to module.
MORE = {"packing_conversations": "packing"}


def queries() -> dict:
    named = {name: module for module, name in MODULES.items()} | MORE
    return {name: getattr(import_module(f"sievemark.llm.{module}"), name) for name, module in named.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"sievemark.llm.{module}"), "ORACLE", None) for module, name in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
