"""Driver-table bindings: every registered query with its oracle SQL."""

import importlib

MODULES = ["retrieval", "text", "catalog", "poi", "personal", "diary", "state", "quality", "streams"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
