"""Registered queries over the test tables."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
