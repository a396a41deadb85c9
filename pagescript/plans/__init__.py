"""Queries of the library's operators over the driver tables."""

from __future__ import annotations

from . import boxes, records


def _modules():
    return (boxes, records)


def queries() -> dict:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
