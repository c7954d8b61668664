"""Registered queries: importing the modules fills the registry."""

import importlib
import pkgutil

from catalog.registry import QUERIES, SQL

for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry"):
    importlib.import_module(f"catalog.{module}")

__all__ = ["QUERIES", "SQL"]
