"""Registered queries, grouped by subject."""

import importlib

MODULES = ["search", "places", "pages", "era_pages", "facts", "routes", "rows", "refresh", "files"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"chronofold.plans.{m}")
