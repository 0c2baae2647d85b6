"""Registered queries of the corpus operators, one module for each operator, and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ["op01_media", "op02_mixing", "op03_jaccard", "op04_shards", "op05_tokens", "op06_toxicity", "op07_quality", "op08_licenses", "op09_sentencepiece", "op10_nearest", "op11_whitening", "op12_divergence", "op13_language"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__name__}.{_name}")
    QUERIES[_module.NAME] = _module.query
    if getattr(_module, "ORACLE_SQL", None):
        ORACLES[_module.NAME] = _module.ORACLE_SQL
