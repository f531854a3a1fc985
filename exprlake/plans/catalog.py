"""All registered queries; importing this module fills the registry."""

import importlib

from exprlake.plans.registry import REGISTRY

MODULES = ["sources", "clean", "normalize", "align", "joins", "aggregate", "ranking", "metrics", "stats", "vectors", "models", "atlas"]
for _name in MODULES:
    importlib.import_module(f"exprlake.plans.catalog_{_name}")

__all__ = ["REGISTRY"]
