"""The query catalogue: name -> (callable, comparison SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("nearby", "history", "ranking", "evaluation", "cleaning", "datasets", "shapes", "stores", "experiments")


def catalogue() -> dict:
    out = {}
    for name in MODULES:
        part = importlib.import_module(f"vicinity.queries.{name}").QUERIES
        clash = set(part) & set(out)
        if clash:
            raise ValueError(f"query names used twice: {clash}")
        out.update(part)
    return out
