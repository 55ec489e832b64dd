"""The registered queries: every operator on the given tables, with the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("cleaning_queries", "profile_queries", "model_queries")


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all catalog modules."""
    for module in _MODULES:
        import_module(f"weirworks.catalog.{module}")
    from weirworks.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
