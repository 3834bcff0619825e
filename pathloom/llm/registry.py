"""The queries of this subpackage, by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

import importlib

#: The modules that hold a QUERIES and an ORACLES dictionary.
MODULES = ["mixing", "bpe", "secrets", "simhash", "quality", "language", "sharding", "metricjoin", "tokens", "topk", "importance", "manifest", "article"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"pathloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
