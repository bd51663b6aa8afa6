"""All registered queries and their SQL, collected from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text", "catalog", "chunking", "retrieval", "reporting"]


def _modules():
    return [import_module(f"proofloom.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
