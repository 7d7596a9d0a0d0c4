"""Queries and SQL of the training-data operators, by the operators' modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["ngram_join", "substring_dedup", "toxicity", "token_files", "html_extract", "line_dedup", "quality_rules", "mixing", "ann", "bpe"]


def queries() -> dict:
    found = {}
    for m in MODULES:
        found |= import_module(f"{__package__}.{m}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for m in MODULES:
        found |= getattr(import_module(f"{__package__}.{m}"), "ORACLES", {})
    return found
