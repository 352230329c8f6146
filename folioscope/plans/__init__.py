"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """(queries, oracles) of every ``*_queries`` module of this package."""
    from . import registry

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod.endswith("_queries"):
            importlib.import_module(f"{__name__}.{mod}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
