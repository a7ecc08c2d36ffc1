"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

MODULES = [
    "quarry.plans.search_queries",
    "quarry.plans.catalog_queries",
    "quarry.plans.analytics_queries",
    "quarry.plans.ingest_queries",
    "quarry.plans.change_queries",
    "quarry.plans.model_queries",
]


def _load():
    queries, sql = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        queries.update(mod.QUERIES)
        sql.update(getattr(mod, "SQL", {}))
    return queries, sql


def _shipping(fn):
    import functools

    from quarry.session import prepare

    @functools.wraps(fn)
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)
    return run


def queries():
    return {k: _shipping(v) for k, v in _load()[0].items()}


def oracle_sql():
    q, s = _load()
    return {k: v for k, v in s.items() if k in q}
