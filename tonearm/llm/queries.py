"""Registered queries of the training-data problems. Importing this module registers them."""

from __future__ import annotations

import importlib

from tonearm.plans.registry import Registry

llm = Registry()

for _name in ("q_caps", "q_splits", "q_leaks", "q_neighbours", "q_overlap", "q_mixing", "q_chunking"):
    importlib.import_module(f"tonearm.llm.{_name}")
