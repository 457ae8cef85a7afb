"""Registered queries: every operator on the derived tables, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

# Family modules, in the order of the operator inventory.
FAMILIES = ["text", "pages", "toc", "resolve", "outline", "chunks", "retrieve", "pack",
            "search", "marks", "turns", "notes", "state", "geometry", "streams"]


def _modules():
    return [importlib.import_module(f"{__name__}.{name}") for name in FAMILIES]


def queries() -> dict[str, Callable]:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
