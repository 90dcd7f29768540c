"""Registered queries with their DuckDB counterparts.

Each module has ``QUERIES`` (name -> (spark, folder) -> DataFrame) and ``ORACLES``
(name -> SQL).  All of them read whole tables.
"""

from __future__ import annotations

import importlib

_MODULES = ("scalars", "matching", "gates", "failures", "enrichment", "extraction", "runs")


def _merged(attribute: str) -> dict:
    result: dict = {}
    for name in _MODULES:
        part = getattr(importlib.import_module(f"{__name__}.{name}"), attribute)
        twice = result.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        result |= part
    return result


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
