"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` gather what the modules register in QUERIES and ORACLE_SQL.
"""

from __future__ import annotations

import importlib
import pkgutil


def _gather(name: str) -> dict:
    found: dict = {}
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        found |= getattr(importlib.import_module(f"{__name__}.{m}"), name, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
