"""The llm queries by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib

_MODULES = ("q_bpe", "q_token_files", "q_quality_rules", "q_urls", "q_licenses", "q_warc", "q_decontamination", "q_jaccard", "q_classifier", "q_language", "q_merkle", "q_exact_dedup", "q_spelling", "q_pipeline")


def _all():
    return [importlib.import_module(f"gridsift.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {k: f for m in _all() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _all() for k, s in m.ORACLES.items()}
