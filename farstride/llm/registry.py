"""Queries of this subpackage and their SQL, gathered from its modules."""

from __future__ import annotations

import importlib

#: Modules that have QUERIES and ORACLE.
MODULES = ["alignment", "decontaminate", "jaccard", "langid", "lattice", "mixing", "negatives", "neighbours", "pieces", "quality", "sharding", "suffixes", "tokens"]


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"{__package__}.{m}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
