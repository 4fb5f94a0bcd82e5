"""Queries over the test tables."""

from importlib import import_module

MODULES = ["text", "segment", "state", "compare", "telemetry", "streams", "pages"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
