"""Binding of the library to the given tables."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def all_queries() -> tuple[dict, dict]:
    """Import every ``q_*`` module once and return (queries, SQL texts)."""
    from pitchgrid.bindings import registry

    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
