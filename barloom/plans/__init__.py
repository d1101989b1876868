"""Registered queries: each composes operators over the given tables."""

from __future__ import annotations

import importlib

MODULES = (
    "flagship",
    "bar_queries",
    "window_queries",
    "indicator_queries",
    "cycle_queries",
    "years_queries",
    "label_queries",
    "metric_queries",
    "selection_queries",
    "config_queries",
    "model_queries",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"barloom.plans.{name}")


def queries() -> dict:
    from barloom.plans.common import QUERIES

    _load()
    return dict(QUERIES)


def checks() -> dict[str, str]:
    from barloom.plans.common import CHECKS

    _load()
    return dict(CHECKS)
