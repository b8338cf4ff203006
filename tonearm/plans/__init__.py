"""Registered queries over the test tables. Importing a module of this package registers its queries."""

from __future__ import annotations

import importlib

MODULES = ["problems", "scores_q", "catalog_q", "matching_q", "vectors_q", "tokens_q", "sources_q"]


def core_registry():
    """The registry with the queries of every module registered."""
    for name in MODULES:
        importlib.import_module(f"tonearm.plans.{name}")
    from tonearm.plans.registry import core

    return core
