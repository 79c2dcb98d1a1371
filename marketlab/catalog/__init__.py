"""Registered queries, one module per operator group."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every group module and return the registry."""
    from marketlab.catalog.registry import REGISTRY

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod != "registry":
            importlib.import_module(f"{__name__}.{mod}")
    return REGISTRY
