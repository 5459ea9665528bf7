"""Queries of this sub-package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from .sql import SQL

#: query -> module; each is imported when the query runs.
MODULES = {
    "op1_ngram_join": "ngram_join",
    "op2_spotsigs": "spotsigs",
    "op3_licenses": "licenses",
    "op4_toxicity": "toxicity",
    "op5_mix_sources": "mixing",
    "op6_ann": "ann",
    "op7_bpe": "bpe",
    "op8_html": "html",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_lm_score": "lm",
    "op11_conversation_repair": "turns",
    "op12_quality": "quality",
    "op13_ranked_search": "dualtree",
}


def _call(name: str, module: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _call(name, module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
