"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("secrets", "chat", "quality", "token_files", "search", "token_counts", "mixing", "packing", "near_dups", "neighbours")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"lumenframe.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})
