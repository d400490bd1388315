"""All queries of the core operators and their SQL oracles, gathered from the modules of ``plans``."""

from __future__ import annotations

import importlib
import pkgutil

from gleaner import plans


def _gather(name: str) -> dict:
    out: dict = {}
    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__)):
        out |= getattr(importlib.import_module(f"gleaner.plans.{m}"), name, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
