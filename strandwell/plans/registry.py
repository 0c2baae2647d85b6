"""Registry of the engine's own queries and of their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ["indexes", "lexical", "dense", "structured", "timeline", "fusion", "evaluation", "catalog", "search", "lanes", "artifacts", "annotation", "runs", "library"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"strandwell.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
