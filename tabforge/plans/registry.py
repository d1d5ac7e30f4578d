"""Registered queries: each binds an operator to the driver's tables.

A query is a function ``(spark, sf_dir) -> DataFrame`` plus, where the result
is expressible in SQL, the DuckDB text that must give the same rows. Column
names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


MODULES = ["q_sources", "q_profile", "q_columns", "q_encode", "q_combine", "q_summarize", "q_sequence",
           "q_impute", "q_features", "q_preprocess", "q_validate", "q_symbolic", "q_models", "q_fitted", "q_search", "q_folds", "q_edges", "q_flow"]


def _load_all() -> None:
    # Importing the modules fills the registry.
    import importlib
    import importlib.util
    for m in MODULES:
        name = f"tabforge.plans.{m}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)


def all_queries() -> dict[str, Callable]:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
