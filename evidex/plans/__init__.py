"""Registered queries of the core, each with its comparison SQL or none."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("expressions", "merging", "retrieval", "checking")


def registry() -> dict:
    """name -> (query, SQL or None)."""
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"evidex.plans.{name}").QUERIES
    return out


def queries() -> dict:
    return {name: query for name, (query, _) in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registry().items() if sql}
