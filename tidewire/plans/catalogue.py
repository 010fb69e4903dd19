"""All registered queries."""

from __future__ import annotations

import importlib

from tidewire.plans.registry import REGISTRY, Query

_MODULES = [
    "articles", "sources", "daily_series", "regressions", "forecasts", "audits",
]


def all_queries() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f"tidewire.plans.queries.{name}")
    return REGISTRY
