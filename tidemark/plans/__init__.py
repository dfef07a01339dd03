"""Registered queries by area."""

from __future__ import annotations

import importlib

AREAS = ["landing", "silver", "dims", "gold", "features", "governance", "monitoring", "audit", "quality", "sampling", "streams"]


def _load():
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    from tidemark.plans import registry
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().ORACLES)
