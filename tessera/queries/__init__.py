"""Registered queries over the given tables."""

import importlib

_MODULES = ("mining", "fitting", "knowing", "web", "records", "flows")


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tessera.queries.{m}")
