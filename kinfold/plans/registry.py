"""Registry of named queries and, where one exists, the plain SQL giving the same answer."""

from __future__ import annotations

import importlib
from typing import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

MODULES = (
    "scan_queries", "scalar_queries", "cohort_queries", "join_queries", "rollup_queries",
    "window_queries", "graph_queries", "metric_queries", "resample_queries", "impute_queries",
    "attribution_queries", "coupling_queries", "gate_queries", "model_queries",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"kinfold.plans.{module}")
