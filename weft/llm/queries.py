"""The queries of this subpackage and, where there is one, their SQL."""

from __future__ import annotations

import importlib

#: Query and the module that has it.
MODULES = {
    "op1_language_id": "language_id",
    "op2_byte_bpe": "byte_bpe",
    "op3_preference_format": "preference_format",
    "op4_mix_sources": "mix_sources",
    "op5_simhash_dedup": "simhash_dedup",
    "op6_quality_rules": "quality_rules",
    "op7_token_attribution": "token_attribution",
    "op8_exact_dedup": "exact_dedup",
    "op9_quality_classifier": "quality_classifier",
    "op10_license_scan": "license_scan",
}
_modules = {k: importlib.import_module(f"weft.llm.{m}") for k, m in MODULES.items()}
QUERIES = {k: getattr(m, k) for k, m in _modules.items()}
SQL = {k: sql for m in _modules.values() for k, sql in getattr(m, "SQL", {}).items() if sql}
