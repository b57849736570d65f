"""Registered queries by operator id. ``load()`` imports every catalog module."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    from scoutlake.catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return registry
