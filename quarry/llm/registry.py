"""The training-data queries and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ["mixing", "simhash", "tokens", "toxicity", "language", "rollup", "secrets", "quality", "decontamination", "substrings", "phrases", "pii", "divergence"]


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"quarry.llm.{m}")
        queries.update(mod.QUERIES)
        sql.update(getattr(mod, "SQL", {}))
    return queries, sql
