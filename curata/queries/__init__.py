"""Registered queries over the test tables and, where SQL can say it, their SQL.

Each module has ``QUERIES`` (name to function of session and folder) and
``SQL`` (name to statement).  The tables stand in for records: an order is a
record, its lines are chains, parts and suppliers are two clusterings.
"""

from __future__ import annotations

import importlib

MODULES = (
    "selection",
    "sampling",
    "catalogs",
    "layout",
    "residues",
    "geometry",
    "metrics",
    "profiles",
    "assemblies",
    "similarity",
    "files",
    "streams",
)


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"curata.queries.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
