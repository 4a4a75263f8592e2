"""All named queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib

from weft.registry import QUERIES, SQL

MODULES = ("operators.graph", "operators.logs", "operators.jobs", "operators.sets", "operators.versions", "operators.regions", "operators.learning", "operators.krylov", "operators.grids", "operators.simulation", "operators.spatial", "operators.extension", "functions.scalars", "functions.arrays", "functions.numeric", "sources.files", "sources.texts", "streaming.windows", "streaming.states")
for _name in MODULES:
    importlib.import_module(f"weft.{_name}")

__all__ = ["QUERIES", "SQL"]
