"""All queries of the engine, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("reading", "governing", "desk", "merging", "sourcing")


def _all(what: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= getattr(import_module(f"fairloom.plans.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
