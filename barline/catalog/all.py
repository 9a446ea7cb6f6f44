"""Import every catalog module and return the registry."""

from __future__ import annotations

import importlib

from barline.catalog.registry import REGISTRY, Entry

MODULES = ["sources", "bars", "joins", "aggregates", "windows", "indicators", "features", "scalars", "events", "xsection", "stats", "ledger", "streaming"]


def load() -> dict[str, Entry]:
    for m in MODULES:
        try:
            importlib.import_module(f"barline.catalog.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"barline.catalog.{m}":
                raise
    return REGISTRY
