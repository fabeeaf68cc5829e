"""Registered queries: each operator on the given tables, with its SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "sources",
    "screening",
    "alignment",
    "quality",
    "features",
    "profiles",
    "forecasting",
    "trading",
    "monitoring",
)


def all_queries() -> dict:
    out = {}
    for family in FAMILIES:
        out.update(import_module(f"entries.{family}").QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for family in FAMILIES:
        out.update(import_module(f"entries.{family}").SQL)
    return out
