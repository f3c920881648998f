"""The jobs run over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("search_queries", "catalog_queries", "job_queries", "event_queries", "attribute_queries", "listing_queries")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"workloads.{name}")
