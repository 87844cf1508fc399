"""All registered queries."""

from __future__ import annotations

import importlib

from corpuskit.plans.registry import ORACLES, QUERIES

MODULES = ("catalog_text", "catalog_keyed", "catalog_corpus", "catalog_layout", "catalog_jobs")
for _module in MODULES:
    importlib.import_module(f"corpuskit.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
